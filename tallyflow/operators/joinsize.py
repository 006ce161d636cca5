"""Sizes of self-joins and of joins of two streams, exactly.

The join itself is never built: counts per key are multiplied and summed.
"""

from __future__ import annotations

from dataclasses import dataclass
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.functions.scalars import wide_product
from tallyflow.operators.frequency import frequency_vector
from tallyflow.operators.segments import Segments, running_products



@dataclass(frozen=True)
class JoinSizeQuery:
    """Self-join of one stream or join of two, with the allowed relative error ``beta``."""

    left: int
    right: int | None = None
    beta: float = 0.0

    def __post_init__(self):
        if self.beta < 0:
            raise ValueError("the allowed error must not be negative")

    @property
    def is_selfjoin(self) -> bool:
        return self.right is None or self.right == self.left

    @property
    def operands(self) -> tuple[int, ...]:
        return (self.left,) if self.is_selfjoin else (self.left, self.right)

    def __str__(self) -> str:
        head = "selfjoin" if self.is_selfjoin else "join"
        return f"{head}({','.join(str(s) for s in self.operands)})"

    def exact(self, stream: DataFrame) -> DataFrame:
        if self.is_selfjoin:
            return selfjoin_size(stream.where(F.col("sid") == self.left))
        return join_size(stream, self.left, self.right)

    def running(self, stream: DataFrame, segments: Segments | None = None) -> DataFrame:
        if self.is_selfjoin:
            return selfjoin_running(stream.where(F.col("sid") == self.left), segments)
        return join_running(stream, self.left, self.right, segments)


def selfjoin_size(stream: DataFrame) -> DataFrame:
    """Second frequency moment of every stream: ``(sid, selfjoin)``."""
    freq = frequency_vector(stream)
    total = F.sum(wide_product(F.col("cnt"), F.col("cnt")))
    return freq.groupBy("sid").agg(total.cast("double").alias("selfjoin"))


def _sided(stream: DataFrame, left: int, right: int, value: str = "upd") -> DataFrame:
    """Both streams in one scan, as columns u1 and u2."""
    zero = F.lit(0).cast("bigint")
    return stream.where(F.col("sid").isin(left, right)).withColumns(
        {
            "u1": F.when(F.col("sid") == left, F.col(value)).otherwise(zero),
            "u2": F.when(F.col("sid") == right, F.col(value)).otherwise(zero),
        }
    )


def join_size(stream: DataFrame, left: int, right: int) -> DataFrame:
    """Join size of two streams on key; one row ``(join_size)``.

    One aggregation holds both counts of a key side by side, so there is no join.
    """
    counts = _sided(stream, left, right).groupBy("key").agg(F.sum("u1").alias("x"), F.sum("u2").alias("y"))
    total = F.sum(wide_product(F.col("x"), F.col("y")))
    return counts.agg(F.coalesce(total, F.lit(0)).cast("double").alias("join_size"))


def selfjoin_running(stream: DataFrame, segments: Segments | None = None) -> DataFrame:
    """Self-join size of each stream after every update: order columns and ``estimate``."""
    seg = segments or Segments.fit(stream)
    rows = stream.select("sid", "key", *seg.order, F.col("upd").alias("u"))
    return running_products(rows, ["key"], by=["sid"], segments=seg).withColumnRenamed("p0", "estimate")


def join_running(stream: DataFrame, left: int, right: int, segments: Segments | None = None) -> DataFrame:
    """Join size of two streams after every update of either."""
    if left == right:
        return selfjoin_running(stream.where(F.col("sid") == left), segments).drop("sid")
    rows = _sided(stream, left, right)
    seg = segments or Segments.fit(rows.select("ts", *[c for c in ("kind", "seq") if c in rows.columns]))
    rows = rows.select("key", *seg.order, "u1", "u2")
    out = running_products(rows, ["key"], "u1", "u2", segments=seg)
    return out.withColumnRenamed("p0", "estimate")


def join_size_matrix(stream: DataFrame, sids: list[int] | None = None) -> DataFrame:
    """Sizes of all self-joins and all joins of two streams: ``(sid1, sid2, join_size)``.

    Every pair of the given streams (of those that occur, if none are given) has a row,
    with size 0 if they share no key.  Counts meet in an equi-join on key, so a key has
    one row per stream and gives one row per pair of streams that have it, as many as
    the matrix has cells, whatever its number of records.
    """
    if sids is None:
        named = stream.select("sid").distinct()
    else:
        named = stream.sparkSession.createDataFrame([(s,) for s in sorted(set(sids))], "sid int")
        stream = stream.where(F.col("sid").isin(*sids))
    pairs = named.select(F.col("sid").alias("sid1")).crossJoin(named.select(F.col("sid").alias("sid2")))
    freq = frequency_vector(stream)
    a = freq.select(F.col("sid").alias("sid1"), "key", F.col("cnt").alias("x"))
    b = freq.select(F.col("sid").alias("sid2"), "key", F.col("cnt").alias("y"))
    joined = a.join(b, "key").where("sid1 <= sid2")
    sizes = joined.groupBy("sid1", "sid2").agg(F.sum(wide_product(F.col("x"), F.col("y"))).alias("size"))
    met = pairs.where("sid1 <= sid2").join(sizes, ["sid1", "sid2"], "left")
    return met.select("sid1", "sid2", F.coalesce("size", F.lit(0)).cast("double").alias("join_size"))


def stream_ids(stream: DataFrame) -> list[int]:
    """The distinct stream ids (16-bit domain)."""
    return sorted(r["sid"] for r in stream.select("sid").distinct().collect())
