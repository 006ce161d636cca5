"""Sliding windows as arrival and expiry records.

A window over an update stream is again an update stream: each record also
yields, later, a record with the opposite sign.  Downstream state is then plain
``sum(upd)`` in stream order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.operators.segments import Segments, positions, previous_values, running_sums

LOCAL_STREAM = ("sid", "hid")


def time_window(stream: DataFrame, length: int, flush: bool = False) -> DataFrame:
    """Each record expires ``length`` ticks later; at equal times arrivals come first.

    Column ``kind`` (0 arrival, 1 expiry) joins the order key.  A stream that has one
    already, as a windowed stream, keeps the order of its own kinds within each of the
    two: the new kind is twice the old one, plus 1 for an expiry.  Without ``flush``
    only expiries before the last arrival are kept.  Stateless, so it also runs
    on a streaming DataFrame (with ``flush``).
    """
    old = F.col("kind") * 2 if "kind" in stream.columns else F.lit(0)
    arrival = F.struct(F.col("ts").alias("ts"), F.col("upd").alias("upd"), old.alias("kind"), F.lit(True).alias("_new"))
    expiry = F.struct(
        (F.col("ts") + F.lit(length)).alias("ts"), (-F.col("upd")).alias("upd"), (old + 1).alias("kind"), F.lit(False).alias("_new")
    )
    rest = [c for c in stream.columns if c not in ("ts", "upd", "kind")]
    out = stream.select(*rest, F.inline(F.array(arrival, expiry)))
    if not flush:
        last = stream.agg(F.max("ts").alias("t")).scalar()
        out = out.where(F.col("_new") | (F.col("ts") < last))
    return out.select(*[c for c in stream.columns if c != "kind"], "kind")


def count_window(
    stream: DataFrame, size: int, flush: bool = False, segments: Segments | None = None
) -> DataFrame:
    """The last ``size`` records are active.

    Record j expires after arrival j+size-1, at that arrival's time.  ``seq`` is
    renumbered so that (ts, seq) is the order of the result.  With ``flush`` the
    records still active at the end expire at the last time.
    """
    _check_size(size)
    at = positions(stream, "_pos", segments=segments)
    times = at.select((F.col("_pos") - F.lit(size - 1)).alias("_pos"), F.col("ts").alias("_end"))
    expiries = at.join(times, "_pos", "left" if flush else "inner")
    if flush:
        last = stream.agg(F.max("ts").alias("t")).scalar()
        expiries = expiries.withColumn("_end", F.coalesce(F.col("_end"), last))
    else:
        # The expiry of j precedes arrival j+size, so that arrival must exist.
        total = stream.agg(F.count(F.lit(1)).alias("n")).scalar()
        expiries = expiries.where(F.col("_pos") + F.lit(size) < total)
    expiries = expiries.withColumns(
        {"ts": F.col("_end"), "upd": -F.col("upd"), "seq": 2 * (F.col("_pos") + F.lit(size - 1)) + 1}
    )
    arrivals = at.withColumn("seq", 2 * F.col("_pos"))
    return arrivals.select(*stream.columns).unionByName(expiries.select(*stream.columns))


def _check_size(size: int) -> None:
    if size < 1:
        raise ValueError("window size must be at least 1")


def active_sizes(
    windowed: DataFrame, by: Sequence[str] = LOCAL_STREAM, segments: Segments | None = None
) -> DataFrame:
    """Number of active records per group after each record, as ``wsize``."""
    return running_sums(windowed, {"wsize": F.col("upd")}, by, segments)


def site_time_window(stream: DataFrame, length: int, segments: Segments | None = None) -> DataFrame:
    """Per local stream: every record expires ``length`` later; with the active size."""
    return active_sizes(time_window(stream, length, flush=True), segments=segments)


def window_load(windowed: DataFrame, by: Sequence[str] = LOCAL_STREAM, segments: Segments | None = None) -> DataFrame:
    """Per group: largest active size and its average over the group's time span.

    The integral of the active size is linear in the updates, so the average
    needs only sums.
    """
    sizes = active_sizes(windowed, by, segments)
    out = sizes.groupBy(*by).agg(
        F.max("wsize").alias("max_size"),
        F.min("ts").alias("_t0"),
        F.max("ts").alias("_t1"),
        F.sum("upd").alias("_u"),
        F.sum(F.col("upd").cast("decimal(19,0)") * F.col("ts").cast("decimal(19,0)")).alias("_ut"),
    )
    area = F.col("_u").cast("decimal(19,0)") * F.col("_t1").cast("decimal(19,0)") - F.col("_ut")
    span = F.col("_t1") - F.col("_t0")
    avg = F.when(span > 0, area.cast("double") / span)
    return out.select(*by, "max_size", avg.alias("avg_size"))


def site_count_window(stream: DataFrame, size: int, segments: Segments | None = None) -> DataFrame:
    """Per local stream: a buffer of ``size`` records.

    A record is evicted by the arrival ``size`` places later in its local stream,
    at that arrival's time and just before it; the rest is never evicted.
    An eviction takes the ``seq`` of its arrival and ``slot`` -1, arrivals have
    ``slot`` 0: the order is (ts, seq, slot).
    """
    _check_size(size)
    at = positions(stream, "_pos", LOCAL_STREAM, segments)
    evictors = at.select(
        *LOCAL_STREAM,
        (F.col("_pos") - F.lit(size)).alias("_pos"),
        F.col("ts").alias("_end"),
        F.col("seq").alias("_by"),
    )
    evicted = at.join(evictors, [*LOCAL_STREAM, "_pos"]).withColumns(
        {"ts": F.col("_end"), "upd": -F.col("upd"), "seq": F.col("_by")}
    )
    cols = [c for c in stream.columns]
    return (
        at.select(*cols, F.lit(0).alias("slot"))
        .unionByName(evicted.select(*cols, F.lit(-1).alias("slot")))
        .select(*cols, "slot")
    )


def window_intervals(stream: DataFrame, size: int, segments: Segments | None = None) -> DataFrame:
    """After each arrival of a local stream: time since its last eviction (since 0 before any)."""
    _check_size(size)
    at = positions(stream, "_pos", LOCAL_STREAM, segments)
    interval = F.when(F.col("_pos") >= size, F.lit(0).cast("bigint")).otherwise(F.col("ts"))
    return at.select(*LOCAL_STREAM, "ts", "seq", interval.alias("winterval"))


def eviction_gaps(stream: DataFrame, size: int, segments: Segments | None = None) -> DataFrame:
    """Time between consecutive evictions of a local stream (NULL for the first)."""
    evicted = site_count_window(stream, size, segments).where("slot = -1")
    seg = segments or Segments.fit(stream)
    gaps = previous_values(evicted, {"ts": "_before"}, LOCAL_STREAM, seg)
    return gaps.select(*LOCAL_STREAM, "ts", "seq", (F.col("ts") - F.col("_before")).alias("gap"))


def sample_hold_integral(
    series: DataFrame, value: str, by: Sequence[str] = (), segments: Segments | None = None
) -> DataFrame:
    """Running integral over time of a series that holds its value until the next row."""
    held = previous_values(series, {value: "_held", "ts": "_since"}, by, segments)
    area = F.coalesce(F.col("_held") * (F.col("ts") - F.col("_since")), F.lit(0))
    out = running_sums(held, {"integral": area}, by, segments)
    return out.drop("_held", "_since")


