"""Per-row-of-sketch ("lane") aggregates that keep empty lanes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lane_table(cells: DataFrame, depth: int, sums: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """``(…, d, sums…)`` with one row for every d below ``depth``; absent lanes sum to 0.

    One hash aggregation by group with depth * len(sums) conditional sums, so the
    shuffle carries one row per group and task.
    """
    wide = cells.groupBy(*by).agg(
        *[
            F.coalesce(F.sum(F.when(F.col("d") == d, e)), F.lit(0)).cast("double").alias(f"_{n}_{d}")
            for d in range(depth)
            for n, e in sums.items()
        ]
    )
    rows = [F.struct(F.lit(d).alias("d"), *[F.col(f"_{n}_{d}").alias(n) for n in sums]) for d in range(depth)]
    return wide.select(*by, F.inline(F.array(*rows)))
