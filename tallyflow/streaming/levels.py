"""Change-of-level filter with versioned state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyflow.operators.levels import level_chain
from tallyflow.streaming.protocols import VersionedTable


class LevelFilter:
    """Streaming form of ``level_changed``: handles micro-batches, with one level per group as state.

    A batch is treated like a series of its own that begins at the levels in force, so a group's
    batch may have any length: it is cut into segments, and no task or state holds it as a whole.
    Within a batch, records are taken in (ts, seq) order; records of an earlier time that come in a
    later batch are taken when they come.  A replayed batch overwrites its own version.
    """

    def __init__(
        self, spark: SparkSession, folder: str, schema: T.StructType, value: str, p: float, d: float = 0.0, by: Sequence[str] = ("sid",)
    ):
        """``schema`` is that of the stream; it gives the types of ``by``."""
        self.value, self.p, self.d, self.by = value, p, d, list(by)
        keys = ", ".join(f"{c} {schema[c].dataType.simpleString()}" for c in self.by)
        self.levels = VersionedTable(spark, f"{folder}/levels", f"{keys}, first double")
        self.rows = VersionedTable(spark, f"{folder}/rows", f"{keys}, ts bigint, seq bigint, level double", log=True)

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        before = self.levels.at(batch_id - 1)
        slim = batch.select(*self.by, "ts", "seq", F.col(self.value).cast("double").alias("level"))
        slim = slim.where("level is not null and not isnan(level)")
        rows = self.rows.write(level_chain(slim, "level", self.p, self.d, self.by, before), batch_id)
        place = F.struct("ts", "seq")
        shown = rows.groupBy(*self.by).agg(F.max_by("level", place).alias("first")).withColumn("_rank", F.lit(0))
        begun = slim.groupBy(*self.by).agg(F.min_by("level", place).alias("first")).withColumn("_rank", F.lit(2))
        every = shown.unionByName(before.withColumn("_rank", F.lit(1))).unionByName(begun)
        self.levels.write(every.groupBy(*self.by).agg(F.min_by("first", "_rank").alias("first")), batch_id)

    def changes(self) -> DataFrame:
        """All rows that became levels so far."""
        return self.rows.all().drop("v")
