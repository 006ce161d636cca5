"""Merging and concatenating streams."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.operators.windows import time_window


def _tagged(streams: Sequence[DataFrame]) -> DataFrame:
    tagged = [s.withColumn("src", F.lit(i)) for i, s in enumerate(streams)]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def stream_merge(*streams: DataFrame) -> DataFrame:
    """Union in time order (ts, src, seq); ``src`` is the input's place."""
    return _tagged(streams)


def stream_concat(*streams: DataFrame) -> DataFrame:
    """One stream after another: the order is (src, ts, seq)."""
    return _tagged(streams)


def renumber(merged: DataFrame) -> DataFrame:
    """Fold ``src`` into ``seq`` so that (ts, seq) is the merged order."""
    highest = merged.agg((F.max("seq") - F.min("seq") + 1).alias("span"), F.min("seq").alias("low"))
    span, low = highest.select("span").scalar(), highest.select("low").scalar()
    return merged.withColumn("seq", F.col("src") * span + F.col("seq") - low).drop("src")


def merge_windowed(length: int, *streams: DataFrame) -> DataFrame:
    """Merge streams together with the expiries of a time window."""
    return time_window(renumber(stream_merge(*streams)), length, flush=True)
