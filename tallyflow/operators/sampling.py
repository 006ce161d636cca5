"""Picking records by position or by change of level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.operators.levels import level_chain
from tallyflow.operators.segments import Segments, positions
from tallyflow.schema import order_columns


def every_nth(stream: DataFrame, n: int, segments: Segments | None = None) -> DataFrame:
    """Records n, 2n, 3n … of the stream order."""
    if n < 1:
        raise ValueError(f"take every 1st, 2nd, ... record, not every {n}th")
    out = positions(stream, "_pos", segments=segments)
    return out.where((F.col("_pos") + 1) % n == 0).drop("_pos")


def spread_choice(position: Column, n: int, total: int) -> Column:
    """Whether a 0-based position is among n evenly spread ones of ``total``, ends included.

    Steps have length q = (total-1) div (n-1), the last ones q+1.
    """
    if total == 0:
        raise ValueError("choose a sampling period other than 0")
    if n >= total:
        return position >= 0
    if n <= 1:
        return position == 0 if n == 1 else F.lit(False)
    q, longer = divmod(total - 1, n - 1)
    bend = (n - 1 - longer) * q
    return F.when(position <= bend, position % q == 0).otherwise((position - bend) % (q + 1) == 0)


def sample_evenly(stream: DataFrame, n: int, segments: Segments | None = None) -> DataFrame:
    """Exactly n evenly spread records, first and last included."""
    total = stream.count()
    if total == 0:
        raise ValueError("choose a sampling period other than 0")
    out = positions(stream, "_pos", segments=segments)
    return out.where(spread_choice(F.col("_pos"), n, total)).drop("_pos")


def sample_series(series: DataFrame, stream: DataFrame, n: int, segments: Segments | None = None) -> DataFrame:
    """The series at n evenly spread records of the stream it was computed from.

    The places are chosen on the bare stream, so the series is evaluated once.
    """
    order = order_columns(stream)
    chosen = sample_evenly(stream.select(*order), n, segments)
    return series.join(chosen, order, "left_semi")


def level_changed(
    series: DataFrame,
    value: str,
    p: float,
    d: float = 0.0,
    by: Sequence[str] = ("sid",),
    first: float | None = None,
    segments: Segments | None = None,
) -> DataFrame:
    """Rows where ``value`` has left the band ``p*|last| + d`` around the last emitted level.

    ``last`` starts at ``first`` or else at the group's first value, and moves only
    when a row is emitted.  A group may be of any length: it is cut into segments, and the
    level in force at the start of each is found without running through those before
    (see ``operators.levels``).  Rows without a value, or with one that is not a number,
    neither have nor leave a level.  ``streaming.levels`` is the incremental form.
    """
    return level_chain(series, value, p, d, by, first, segments)
