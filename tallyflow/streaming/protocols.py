"""Continuous monitoring per micro-batch, with versioned state tables.

Each batch adds its records' sketches to the state of the batch before and writes
a new version named by its batch id.  A batch that is replayed after a failure
reads the same old version and overwrites its own, so nothing is counted twice.
All sums are distributed; the state has at most sites * D * L rows per stream,
and only single summary rows come to the driver.  Rules are checked at batch
ends: a bound may be crossed within a batch before it is reported.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.functions import guard_math
from tallyflow.functions.scalars import publish_bytes, wide_product
from tallyflow.operators import guards
from tallyflow.operators.joinsize import JoinSizeQuery
from tallyflow.operators.monitor import _SUM_SHARE, RULES
from tallyflow.operators.sketch import Projection, join_estimate, selfjoin_estimate, sketch


@dataclass
class VersionedTable:
    """One Parquet folder per batch id; all of a log, else the last two (a replayed batch needs the one before)."""

    spark: SparkSession
    folder: str
    schema: str
    log: bool = False

    def at(self, version: int) -> DataFrame:
        if version < 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/v={version}")

    def write(self, df: DataFrame, version: int) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.folder}/v={version}")
        if not self.log:
            old = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/v={version - 2}")
            old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)
        return self.at(version)

    def all(self) -> DataFrame:
        """All versions, with column ``v``."""
        try:
            return self.spark.read.option("basePath", self.folder).parquet(f"{self.folder}/v=*")
        except AnalysisException:
            return self.spark.createDataFrame([], self.schema).withColumn("v", F.lit(0))


class DriftPublisher:
    """Publish a local stream's drift once its squared norm reaches a share of the whole's."""

    def __init__(self, spark: SparkSession, folder: str, proj: Projection, theta: float, sites: int):
        self.proj, self.limit = proj, theta * theta / sites
        self.state = VersionedTable(
            spark, f"{folder}/state", "sid int, hid int, d int, b int, total bigint, drift bigint"
        )
        self.counts = VersionedTable(spark, f"{folder}/counts", "sid int, hid int, updates bigint, fired boolean")
        self.log = VersionedTable(spark, f"{folder}/log", "sid int, hid int, d int, b int, c bigint", log=True)

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        by = ["sid", "hid"]
        new = sketch(batch, self.proj, by)
        old = self.state.at(batch_id - 1)
        cells = (
            old.unionByName(new.select(*by, "d", "b", F.col("c").alias("total"), F.col("c").alias("drift")))
            .groupBy(*by, "d", "b")
            .agg(F.sum("total").alias("total"), F.sum("drift").alias("drift"))
        )
        sizes = cells.groupBy(*by).agg(
            F.sum(wide_product(F.col("drift"), F.col("drift"))).cast("double").alias("drift2"),
            F.sum(wide_product(F.col("total"), F.col("total"))).cast("double").alias("total2"),
        )
        waiting = self.counts.at(batch_id - 1).where("not fired").select(*by, "updates")
        arrived = batch.groupBy(*by).agg(F.count(F.lit(1)).alias("updates"))
        pending = waiting.unionByName(arrived).groupBy(*by).agg(F.sum("updates").alias("updates"))
        # As in batch: a local stream is looked at when it has new records, whatever they sum up to.
        fired = (F.col("drift2") >= F.lit(self.limit) * F.col("total2")) & F.col("_new").isNotNull()
        counts = self.counts.write(
            sizes.join(pending, by, "left").join(arrived.select(*by, F.lit(True).alias("_new")), by, "left").select(
                *by, F.coalesce("updates", F.lit(0)).alias("updates"), fired.alias("fired")
            ),
            batch_id,
        )
        flagged = cells.join(counts.select(*by, "fired"), by)
        self.log.write(
            flagged.where("fired and drift <> 0").select(*by, "d", "b", F.col("drift").alias("c")), batch_id
        )
        reset = F.when(F.col("fired"), F.lit(0).cast("bigint")).otherwise(F.col("drift"))
        self.state.write(flagged.select(*by, "d", "b", "total", reset.alias("drift")), batch_id)

    def published(self) -> DataFrame:
        """All published cells with their batch."""
        return self.log.all().withColumnRenamed("v", "batch")

    def estimate(self) -> DataFrame:
        """Self-join estimate from everything published."""
        total = self.published().groupBy("sid", "d", "b").agg(F.sum("c").alias("c"))
        return selfjoin_estimate(total, self.proj)


def _operands(batch: DataFrame, query: JoinSizeQuery) -> DataFrame:
    """The records of a query's streams, with their place in it."""
    which = F.coalesce(*[F.when(F.col("sid") == s, F.lit(i)) for i, s in enumerate(query.operands)])
    return batch.where(F.col("sid").isin(*query.operands)).withColumn("operand", which)


class StreamedJoinSize:
    """Exact and sketched value of a query after every micro-batch, from counts per key and per sketch cell."""

    def __init__(self, spark: SparkSession, folder: str, query: JoinSizeQuery, proj: Projection):
        self.query, self.proj = query, proj
        self.counts = VersionedTable(spark, f"{folder}/counts", "operand int, key bigint, c bigint")
        self.cells = VersionedTable(spark, f"{folder}/cells", "operand int, d int, b int, c bigint")
        self.values = VersionedTable(spark, f"{folder}/values", "batch bigint, exact double, estimate double", log=True)

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        mine = _operands(batch, self.query)
        counts = self._grown(self.counts, mine.groupBy("operand", "key").agg(F.sum("upd").alias("c")), batch_id)
        cells = self._grown(self.cells, sketch(mine, self.proj, ["operand"]), batch_id)
        side = [F.sum(F.when(F.col("operand") == i, F.col("c")).otherwise(F.lit(0))).alias(f"c{i}") for i in (0, 1)]
        other = "c0" if self.query.is_selfjoin else "c1"
        product = wide_product(F.col("c0"), F.col(other))
        exact = counts.groupBy("key").agg(*side).agg(F.coalesce(F.sum(product), F.lit(0)).cast("double").alias("exact"))
        dots = cells.groupBy("d", "b").agg(*side).groupBy("d").agg(F.sum(product).cast("double").alias("dot"))
        every = batch.sparkSession.range(self.proj.depth).select(F.col("id").cast("int").alias("d"))
        lanes = every.join(dots, "d", "left").agg(F.median(F.coalesce("dot", F.lit(0.0))).alias("estimate"))
        row = exact.crossJoin(lanes).select(F.lit(batch_id).cast("bigint").alias("batch"), "exact", "estimate")
        self.values.write(row, batch_id)

    def _grown(self, table: VersionedTable, new: DataFrame, batch_id: int) -> DataFrame:
        both = table.at(batch_id - 1).unionByName(new)
        keys = [c for c in new.columns if c != "c"]
        return table.write(both.groupBy(*keys).agg(F.sum("c").alias("c")).where("c <> 0"), batch_id)


_ROUND = (
    "batch bigint, reanchored boolean, estimate double, low double, high double, zeta_anchor double, "
    "zeta_min double, zeta_sum double, updates bigint, bytes bigint"
)


class GuardedEstimate:
    """Keep an anchored join-size estimate and re-anchor when the sites' guards ask for it."""

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        query: JoinSizeQuery,
        proj: Projection,
        sites: int,
        rule: str = "any_site",
        exact: bool = True,
        guard: Callable[[float, float], guards.Guard] | None = None,
    ):
        """``guard`` makes the guard for given bounds; by default the query's own."""
        if rule not in RULES:
            raise ValueError(f"unknown rule {rule!r}; use one of {RULES}")
        if proj.epsilon >= query.beta:
            raise ValueError("total error must exceed the sketch error")
        self.query, self.proj, self.sites, self.rule = query, proj, sites, rule
        own = guards.SelfjoinGuard if query.is_selfjoin else guards.JoinGuard
        self.guard = guard or (lambda low, high: own(proj, low, high, exact))
        self.anchor = VersionedTable(spark, f"{folder}/anchor", "operand int, d int, b int, c bigint")
        self.drift = VersionedTable(spark, f"{folder}/drift", "hid int, operand int, d int, b int, c bigint")
        self.pending = VersionedTable(spark, f"{folder}/pending", "hid int, updates bigint")
        self.rounds = VersionedTable(spark, f"{folder}/rounds", _ROUND, log=True)

    def _estimate(self, anchor: DataFrame) -> float:
        if self.query.is_selfjoin:
            row = selfjoin_estimate(anchor, self.proj, []).first()
        else:
            side = lambda i: anchor.where(F.col("operand") == i).select("d", "b", "c")
            row = join_estimate(side(0), side(1), self.proj).first()
        return float(row[0]) if row and row[0] is not None else 0.0

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        spark, cells = batch.sparkSession, ["hid", "operand", "d", "b"]
        mine = _operands(batch, self.query)
        new = sketch(mine, self.proj, ["hid", "operand"])
        drift = self.drift.at(batch_id - 1).unionByName(new.select(*cells, "c"))
        drift = self.drift.write(drift.groupBy(*cells).agg(F.sum("c").alias("c")), batch_id)
        arrived = mine.groupBy("hid").agg(F.count(F.lit(1)).alias("updates"))
        pending = self.pending.at(batch_id - 1).unionByName(arrived)
        pending = self.pending.write(pending.groupBy("hid").agg(F.sum("updates").alias("updates")), batch_id)

        anchor = self.anchor.at(batch_id - 1)
        estimate = self._estimate(anchor)
        low, high = guard_math.bounds(estimate, self.query.beta, self.proj.epsilon)
        if batch_id == 0:
            zeta_anchor = zeta_min = zeta_sum = None
            moved = True
        else:
            zeta_anchor, zeta_min, zeta_sum = self._check(drift, anchor, low, high)
            if self.rule == "any_site":
                moved = zeta_min <= 0
            else:
                moved = zeta_sum < _SUM_SHARE * self.sites * zeta_anchor
        updates = shipped = 0
        if moved:
            size = len(self.query.operands) * self.proj.cells
            sent = pending.agg(F.sum("updates"), F.sum(publish_bytes(F.col("updates"), size))).first()
            updates, shipped = int(sent[0] or 0), int(sent[1] or 0)
            grown = anchor.unionByName(drift.drop("hid")).groupBy("operand", "d", "b").agg(F.sum("c").alias("c"))
            anchor = self.anchor.write(grown, batch_id)
            estimate = self._estimate(anchor)
            low, high = guard_math.bounds(estimate, self.query.beta, self.proj.epsilon)
            self.drift.write(spark.createDataFrame([], self.drift.schema), batch_id)
            self.pending.write(spark.createDataFrame([], self.pending.schema), batch_id)
        else:
            self.anchor.write(anchor, batch_id)
        row = (batch_id, moved, estimate, low, high, zeta_anchor, zeta_min, zeta_sum, updates, shipped)
        self.rounds.write(spark.createDataFrame([row], _ROUND), batch_id)

    def _check(self, drift: DataFrame, anchor: DataFrame, low: float, high: float) -> tuple[float, float, float]:
        """Guard of the anchor, and smallest and summed guard of the sites."""
        seen = drift.select("hid").distinct()
        scaled = drift.withColumn("c", F.col("c") * self.sites)
        hosts = seen.agg(F.collect_list("hid").alias("h")).scalar()
        # Host ids are 16-bit, the anchor has arity*D*L rows; hid -1 stands for the anchor itself.
        everywhere = anchor.select(F.explode(F.array_append(hosts, F.lit(-1))).alias("hid"), "operand", "d", "b", "c")
        states = scaled.unionByName(everywhere).groupBy("hid", "operand", "d", "b").agg(F.sum("c").alias("c"))
        zetas = self.guard(low, high).zeta(states, anchor, ["hid"])
        row = zetas.agg(
            F.max(F.when(F.col("hid") == -1, F.col("zeta"))).alias("anchor"),
            F.min(F.when(F.col("hid") >= 0, F.col("zeta"))).alias("low"),
            F.sum(F.when(F.col("hid") >= 0, F.col("zeta"))).alias("sum"),
            F.count_if(F.col("hid") >= 0).alias("n"),
        ).first()
        idle = self.sites - row["n"]
        low_zeta = row["anchor"] if row["low"] is None else row["low"]
        if idle:
            low_zeta = min(low_zeta, row["anchor"])
        return row["anchor"], low_zeta, (row["sum"] or 0.0) + idle * row["anchor"]
