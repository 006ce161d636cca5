"""Windowed counts over an unbounded update stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.streaming.feeds import with_event_time


def window_counts(
    stream: DataFrame,
    length: int,
    slide: int | None = None,
    lateness: str = "0 seconds",
    by: Sequence[str] = ("sid",),
) -> DataFrame:
    """Sum of updates per group in tumbling or sliding windows of integer seconds.

    ``active`` of the window that ends at t is the number of records a time
    window of ``length`` holds at t.  Records later than ``lateness`` are left
    out; in batch all are counted.  State is one number per group and open window.
    """
    timed = with_event_time(stream, lateness)
    cut = F.window("event_time", f"{length} seconds", f"{slide or length} seconds")
    out = timed.groupBy(cut.alias("w"), *by).agg(F.sum("upd").alias("active"))
    return out.select(
        F.unix_timestamp("w.start").alias("window_start"), F.unix_timestamp("w.end").alias("window_end"), *by, "active"
    )
