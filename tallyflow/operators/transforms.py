"""Per-record transforms and cuts of update streams."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.operators.segments import Segments, positions, previous_values
from tallyflow.operators.selection import between_positions
from tallyflow.operators.windows import count_window, time_window
from tallyflow.schema import order_columns


def max_length(stream: DataFrame, n: int) -> DataFrame:
    """The first n records in stream order, by a bound on their order."""
    return between_positions(stream, 0, n)


def max_timestamp(stream: DataFrame, last: int) -> DataFrame:
    return stream.where(F.col("ts") <= last)


def hash_streams(stream: DataFrame, n: int) -> DataFrame:
    return stream.withColumn("sid", F.pmod("sid", F.lit(n)).cast("int"))


def hash_sources(stream: DataFrame, n: int) -> DataFrame:
    return stream.withColumn("hid", F.pmod("hid", F.lit(n)).cast("int"))


def negate(stream: DataFrame) -> DataFrame:
    return stream.withColumn("upd", -F.col("upd"))


def time_shift(stream: DataFrame, by: int) -> DataFrame:
    return stream.withColumn("ts", F.col("ts") + F.lit(by).cast("bigint"))


def loop_replay(stream: DataFrame, loops: int) -> DataFrame:
    """Replay the stream ``loops`` times, each copy starting one tick after the last ended."""
    if loops < 1:
        raise ValueError("loops must be at least 1")
    if loops == 1:
        return stream
    extent = stream.agg(
        (F.max("ts") - F.min("ts") + 1).alias("span"), (F.max("seq") - F.min("seq") + 1).alias("ids")
    )
    copies = stream.withColumn("_loop", F.explode(F.sequence(F.lit(0), F.lit(loops - 1)))).withColumns(
        {"_span": extent.select("span").scalar(), "_ids": extent.select("ids").scalar()}
    )
    return copies.select(
        *[c for c in stream.columns if c not in ("ts", "seq")],
        (F.col("ts") + F.col("_loop") * F.col("_span")).alias("ts"),
        (F.col("seq") + F.col("_loop") * F.col("_ids")).alias("seq"),
    ).select(*stream.columns)


def time_slice(stream: DataFrame, start: int, end: int) -> DataFrame:
    """Records with start <= ts < end."""
    return stream.where((F.col("ts") >= start) & (F.col("ts") < end))


def position_slice(stream: DataFrame, start: int, end: int) -> DataFrame:
    """Records at positions start..end-1 of the stream order."""
    return between_positions(stream, start, end)


def time_index(stream: DataFrame, *times: int) -> DataFrame:
    """For each time, the position of the first record at or after it."""
    counts = stream.agg(*[F.count_if(F.col("ts") < t).alias(f"at_{i}") for i, t in enumerate(times)])
    pairs = F.array(
        *[F.struct(F.lit(t).cast("bigint").alias("ts"), F.col(f"at_{i}").alias("pos")) for i, t in enumerate(times)]
    )
    return counts.select(F.inline(pairs))


def extent(stream: DataFrame) -> DataFrame:
    """Start time, end time and number of records."""
    return stream.agg(
        F.min("ts").alias("ts_start"), F.max("ts").alias("ts_end"), F.count(F.lit(1)).alias("length")
    )


def order_violations(stream: DataFrame, by: str = "seq") -> DataFrame:
    """Number of records whose ts is below that of the record before it in ``by`` order."""
    seg = Segments.fit(stream, [by])
    pairs = previous_values(stream.select("ts", by), {"ts": "_before"}, segments=seg)
    return pairs.agg(F.count_if(F.col("ts") < F.col("_before")).alias("violations"))


def ordered(stream: DataFrame) -> DataFrame:
    """Sort by time, ties in record order."""
    return stream.orderBy(*order_columns(stream))


def warmup_split(
    stream: DataFrame,
    time: int | None = None,
    size: int | None = None,
    segments: Segments | None = None,
    check: bool = False,
) -> DataFrame:
    """Add boolean ``warmup``: the first ``time`` ticks or the first ``size`` records.

    With ``check``, one job verifies that some record is left after the warm-up.
    """
    if (time is None) == (size is None):
        raise ValueError("give either a warm-up time or a warm-up size")
    if time is not None:
        first = stream.agg(F.min("ts").alias("t")).scalar()
        out = stream.withColumn("warmup", F.col("ts") < first + F.lit(time))
    else:
        out = positions(stream, "_pos", segments=segments)
        out = out.withColumn("warmup", F.col("_pos") < size).drop("_pos")
    if check and not out.where(~F.col("warmup")).take(1):
        raise ValueError("the warm-up takes up the whole stream")
    return out


def record_map(
    stream: DataFrame, edit: Callable[[DataFrame], DataFrame], ends: Callable[[DataFrame], Column] | None = None
) -> DataFrame:
    """Apply a record-wise DataFrame function; it must keep the update columns.

    With ``ends``, the stream stops before the first record for which that condition holds,
    whatever the records behind it: its order key is the least that meets the condition.
    """
    if ends is not None:
        order = order_columns(stream)
        key = F.struct(*order)
        first = stream.where(ends(stream)).agg(F.min(key).alias("first"))
        time = first.select(f"first.{order[0]}").scalar()
        before = (F.col(order[0]) <= time) & (key < first.select("first").scalar())
        stream = stream.where(first.select(F.col("first").isNull()).scalar() | before)
    out = stream.transform(edit)
    missing = [c for c in stream.columns if c not in out.columns]
    if missing:
        raise ValueError(f"record_map dropped {missing}")
    return out


@dataclass(frozen=True)
class Preparation:
    """Options of :func:`prepare`, applied in the order of the fields."""

    loops: int | None = None
    max_length: int | None = None
    max_timestamp: int | None = None
    hash_streams: int | None = None
    hash_sources: int | None = None
    time_window: int | None = None
    fixed_window: int | None = None
    flush_window: bool = False
    warmup_time: int | None = None
    warmup_size: int | None = None

    def __post_init__(self):
        if self.time_window is not None and self.fixed_window is not None:
            raise ValueError("time_window and fixed_window exclude one another")
        if self.warmup_time is not None and self.warmup_size is not None:
            raise ValueError("warmup_time and warmup_size exclude one another")


def prepare(stream: DataFrame, options: Preparation) -> DataFrame:
    """Run the preparation steps in their fixed order; warm-up is cut after windowing."""
    steps: list[tuple[object, Callable[[DataFrame], DataFrame]]] = [
        (options.loops, lambda s: loop_replay(s, options.loops)),
        (options.max_length, lambda s: max_length(s, options.max_length)),
        (options.max_timestamp, lambda s: max_timestamp(s, options.max_timestamp)),
        (options.hash_streams, lambda s: hash_streams(s, options.hash_streams)),
        (options.hash_sources, lambda s: hash_sources(s, options.hash_sources)),
        (options.time_window, lambda s: time_window(s, options.time_window, options.flush_window)),
        (options.fixed_window, lambda s: count_window(s, options.fixed_window, options.flush_window)),
    ]
    for wanted, step in steps:
        if wanted is not None:
            stream = stream.transform(step)
    if options.warmup_time is None and options.warmup_size is None:
        return stream.withColumn("warmup", F.lit(False))
    return warmup_split(stream, options.warmup_time, options.warmup_size)


