"""Analytics on result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.functions.predicates import matches
from tallyflow.operators.frequency import analyze, duration
from tallyflow.schema import RECORD_BYTES


def frame(
    table: DataFrame,
    columns: Sequence[str] = ("*",),
    where=None,
    order: Sequence[str] = (),
    distinct: bool = False,
) -> DataFrame:
    """Choose columns and rows of a result table."""
    out = table.where(matches(where)) if where else table
    out = out.select(*columns)
    out = out.distinct() if distinct else out
    return out.orderBy(*order) if order else out


def axis_values(table: DataFrame, columns: Sequence[str], where=None) -> DataFrame:
    """Distinct values of some columns, in order."""
    return frame(table, columns, where, columns, distinct=True)


def derived_view(table: DataFrame, name: str, **columns) -> DataFrame:
    """Register a view with computed columns, and return it."""
    out = table.withColumns(columns)
    out.createOrReplaceTempView(name)
    return out


def series(table: DataFrame, x: str, y: str | Sequence[str], axes: Sequence[str], where=None) -> DataFrame:
    """Long table of one (x, y) series per distinct combination of the axes.

    With several y columns, ``series`` names the one a row comes from.
    """
    rows = table.where(matches(where)) if where else table
    if isinstance(y, str):
        return rows.select(*axes, F.col(x).alias("x"), F.col(y).alias("y")).orderBy(*axes, "x")
    long = rows.select(*axes, F.col(x).alias("x"), *[F.col(c).cast("double").alias(c) for c in y])
    long = long.unpivot([*axes, "x"], list(y), "series", "y")
    return long.orderBy(*axes, "series", "x")


def comm_summary(stream: DataFrame, traffic: DataFrame, name: str = "stream", window: int = 0, warmup: int = 0) -> DataFrame:
    """Per run and network: dataset facts, messages, bytes and their ratio to raw shipping."""
    meta = analyze(stream, name, window, warmup).select(
        F.struct(
            F.col("name").alias("dset_name"),
            F.col("window").alias("dset_window"),
            F.col("warmup").alias("dset_warmup"),
            F.col("size").alias("dset_size"),
            duration().alias("dset_duration"),
            F.size("stream_ids").alias("dset_streams"),
            F.size("source_ids").alias("dset_hosts"),
            (F.col("size") * RECORD_BYTES).alias("dset_bytes"),
        ).alias("m")
    )
    totals = traffic.groupBy("run_id", "netname", "protocol").agg(
        F.sum("msgs").alias("total_msg"), F.sum("bytes").alias("total_bytes")
    )
    out = totals.withColumn("_m", meta.scalar()).select(
        "run_id", "netname", "protocol", "_m.*", "total_msg", "total_bytes"
    )
    return out.withColumn("traffic_ratio", F.col("total_bytes") / F.col("dset_bytes"))
