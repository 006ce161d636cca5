"""Metadata, counts and frequency vectors.

Group sums combine before the shuffle, so a key that holds a third of all rows
costs one partial row per task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.functions.scalars import wide_product
from tallyflow.operators.segments import Segments, running_groups, running_sums
from tallyflow.session import cut_lineage


def analyze(stream: DataFrame, name: str = "stream", window: int = 0, warmup: int = 0) -> DataFrame:
    """One metadata row.  The id sets come from 16-bit domains, so they stay small."""
    return stream.agg(
        F.count(F.lit(1)).alias("size"),
        F.min("ts").alias("ts_min"),
        F.max("ts").alias("ts_max"),
        F.min("key").alias("key_min"),
        F.max("key").alias("key_max"),
        F.sort_array(F.collect_set("sid")).alias("stream_ids"),
        F.sort_array(F.collect_set("hid")).alias("source_ids"),
    ).select(
        F.lit(name).alias("name"),
        "size",
        "ts_min",
        "ts_max",
        "key_min",
        "key_max",
        "stream_ids",
        "source_ids",
        F.lit(window).cast("bigint").alias("window"),
        F.lit(warmup).cast("bigint").alias("warmup"),
    )


def duration() -> Column:
    return F.col("ts_max") - F.col("ts_min") + 1


def merge_metadata(parts: DataFrame, name: str = "merged") -> DataFrame:
    """Combine metadata rows: sums, extremes and set unions."""
    return parts.agg(
        F.sum("size").alias("size"),
        F.min("ts_min").alias("ts_min"),
        F.max("ts_max").alias("ts_max"),
        F.min("key_min").alias("key_min"),
        F.max("key_max").alias("key_max"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("stream_ids")))).alias("stream_ids"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("source_ids")))).alias("source_ids"),
        F.max("window").alias("window"),
        F.max("warmup").alias("warmup"),
    ).select(F.lit(name).alias("name"), "*")


def local_stream_matrix(stream: DataFrame) -> DataFrame:
    """Record count for every combination of seen stream and host ids, zeros included."""
    ids = stream.agg(F.collect_set("sid").alias("s"), F.collect_set("hid").alias("h"))
    pairs = ids.select(F.explode("s").alias("sid"), "h").select("sid", F.explode("h").alias("hid"))
    counts = stream.groupBy("sid", "hid").agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(counts, ["sid", "hid"], "left").select(
        "sid", "hid", F.coalesce("n", F.lit(0)).alias("stream_len")
    )


def stream_totals(stream: DataFrame) -> DataFrame:
    """Per stream: records and hosts."""
    per_local = stream.groupBy("sid", "hid").agg(F.count(F.lit(1)).alias("n"))
    return per_local.groupBy("sid").agg(F.sum("n").alias("records"), F.count(F.lit(1)).alias("hosts"))


def active_series(windowed: DataFrame, segments: Segments | None = None) -> DataFrame:
    """Running sum of updates per local stream, per stream and per host."""
    upd = F.col("upd")
    specs = [
        (["sid", "hid"], {"local_active": upd}),
        (["sid"], {"stream_active": upd}),
        (["hid"], {"host_active": upd}),
    ]
    return running_groups(windowed, specs, segments)


def frequency_vector(stream: DataFrame, by: Sequence[str] = ("sid",)) -> DataFrame:
    """Key counts: sum of updates per group and key."""
    return stream.groupBy(*by, "key").agg(F.sum("upd").alias("cnt"))


def pack(freq: DataFrame) -> DataFrame:
    """Drop zero entries."""
    return freq.where("cnt <> 0")


def pointwise_map(freq: DataFrame, f: Callable[[Column, Column], Column], name: str = "cnt") -> DataFrame:
    """Apply f(key, count) to every entry."""
    return freq.withColumn(name, f(F.col("key"), F.col("cnt")))


def pointwise_combine(
    a: DataFrame, b: DataFrame, f: Callable[[Column, Column], Column], on: Sequence[str] = ("key",), name: str = "cnt"
) -> DataFrame:
    """f(a[key], b[key]) over the union of both domains, a missing count being 0."""
    on = list(on)
    x = a.select(*on, F.col("cnt").alias("_x"))
    y = b.select(*on, F.col("cnt").alias("_y"))
    zero = F.lit(0)
    joined = x.join(y, on, "full")
    return joined.select(*on, f(F.coalesce("_x", zero), F.coalesce("_y", zero)).alias(name))


def inner_product(a: DataFrame, b: DataFrame, on: Sequence[str] = ("key",)) -> DataFrame:
    """Sum over common keys of the product of counts; one row, column ``product``."""
    on = list(on)
    x = a.select(*on, F.col("cnt").alias("_x"))
    y = b.select(*on, F.col("cnt").alias("_y"))
    total = F.sum(wide_product(F.col("_x"), F.col("_y")))
    return x.join(y, on).agg(F.coalesce(total, F.lit(0)).cast("double").alias("product"))


def self_product(freq: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    total = F.sum(wide_product(F.col("cnt"), F.col("cnt")))
    return freq.groupBy(*by).agg(F.coalesce(total, F.lit(0)).cast("double").alias("product"))


def norms(freq: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """L1, L2 and L-infinity norm of each frequency vector."""
    size = F.abs(F.col("cnt"))
    return freq.groupBy(*by).agg(
        F.sum(size).alias("l1"),
        F.sqrt(F.sum(wide_product(F.col("cnt"), F.col("cnt"))).cast("double")).alias("l2"),
        F.max(size).alias("linf"),
    )


def cosine_similarity(a: DataFrame, b: DataFrame, on: Sequence[str] = ("key",)) -> DataFrame:
    """Cosine of two frequency vectors, from one pass over their common domain."""
    on = list(on)
    x = a.select(*on, F.col("cnt").alias("_x"))
    y = b.select(*on, F.col("cnt").alias("_y"))
    p = {
        "xy": F.sum(wide_product(F.col("_x"), F.col("_y"))),
        "xx": F.sum(wide_product(F.col("_x"), F.col("_x"))),
        "yy": F.sum(wide_product(F.col("_y"), F.col("_y"))),
    }
    sums = x.join(y, on, "full").agg(*[F.coalesce(e, F.lit(0)).cast("double").alias(n) for n, e in p.items()])
    return sums.select((F.col("xy") / (F.sqrt("xx") * F.sqrt("yy"))).alias("cosine"))


def dense_dot(a: Column, b: Column) -> Column:
    """Dot product of two array columns."""
    pairs = F.zip_with(a, b, lambda u, v: u.cast("double") * v.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + p)


def dense_norms(a: Column) -> dict[str, Column]:
    """L1, L2 and L-infinity norm of an array column."""
    sizes = F.transform(a, lambda x: F.abs(x.cast("double")))
    return {
        "l1": F.aggregate(sizes, F.lit(0.0), lambda acc, x: acc + x),
        "l2": F.sqrt(dense_dot(a, a)),
        "linf": F.array_max(sizes),
    }


def order_select(df: DataFrame, value: str, k: int, by: Sequence[str] = ()) -> DataFrame:
    """The k-th smallest value (0-based) of each group; NULLs are no values.

    Counts per distinct value come first, so repeated values never reach one task,
    and their running count is taken in segments of the value's range.  A group with
    at most k values raises.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    missing = F.raise_error(F.lit(f"order_select: a group has no more than {k} values")).cast(df.schema[value].dataType)
    hit = F.min(F.when(F.col("_upto") > k, F.col("_value")))
    return _ranked(df, value, by).groupBy(*by).agg(F.coalesce(hit, missing).alias(value))


def _ranked(df: DataFrame, value: str, by: Sequence[str], totals: bool = False) -> DataFrame:
    """Distinct values of each group with their count ``_n`` and the count ``_upto`` of values up to them.

    With ``totals``, ``_total`` is the group's number of values; it comes from the counts, so they are ranked once.
    """
    counts = cut_lineage(df.groupBy(*by, F.col(value).alias("_value")).agg(F.count(value).alias("_n")))
    ranked = running_sums(counts, {"_upto": F.col("_n")}, by, Segments.fit(counts, ["_value"]))
    if not totals:
        return ranked
    whole = counts.groupBy(*by).agg(F.sum("_n").alias("_total"))
    return ranked.join(whole, list(by)) if by else ranked.crossJoin(whole)


def median(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact median of each group, the mean of the middle two for an even count; NULL without values.

    Works like :func:`order_select`.
    """
    both = _ranked(df, value, by, totals=True)
    lower = F.min(F.when(F.col("_upto") > F.expr("(_total - 1) div 2"), F.col("_value")))
    upper = F.min(F.when(F.col("_upto") > F.expr("_total div 2"), F.col("_value")))
    return both.groupBy(*by).agg(((lower + upper) / 2.0).alias("median"))
