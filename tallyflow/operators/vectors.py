"""Dense vectors in long form ``(…, i, v)`` and their sparse changes ``(…, i, old, new)``."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def apply_delta(vector: DataFrame, delta: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The vector after the change; indices that the change adds are kept."""
    on = [*by, "i"]
    hit = vector.join(delta.select(*on, "new"), on, "full")
    return hit.select(*on, F.coalesce("new", "v").alias("v"))


def rebase_delta(vector: DataFrame, delta: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The same change, moved to start from ``vector``'s values."""
    on = [*by, "i"]
    step = F.col("new") - F.col("old")
    hit = delta.join(vector, on, "left")
    base = F.coalesce(F.col("v"), F.lit(0.0))
    return hit.select(*on, base.alias("old"), (base + step).alias("new"))


def mask_delta(delta: DataFrame, keep: Column) -> DataFrame:
    return delta.where(keep)


def combine_deltas(
    a: DataFrame, b: DataFrame, f: Callable[[Column, Column], Column], by: Sequence[str] = ()
) -> DataFrame:
    """f on old and on new values over the union of indices, missing values being 0."""
    on = [*by, "i"]
    x = a.select(*on, F.col("old").alias("_ao"), F.col("new").alias("_an"))
    y = b.select(*on, F.col("old").alias("_bo"), F.col("new").alias("_bn"))
    j = x.join(y, on, "full")
    z = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("_ao", "_an", "_bo", "_bn")}
    return j.select(*on, f(z["_ao"], z["_bo"]).alias("old"), f(z["_an"], z["_bn"]).alias("new"))


def dot(a: DataFrame, b: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    on = [*by, "i"]
    j = a.select(*on, F.col("v").alias("_a")).join(b.select(*on, F.col("v").alias("_b")), on)
    return j.groupBy(*by).agg(F.sum(F.col("_a") * F.col("_b")).alias("dot"))


def dot_change(delta: DataFrame, other: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """How the dot product with ``other`` moves, from the change alone."""
    on = [*by, "i"]
    j = delta.join(other, on)
    return j.groupBy(*by).agg(F.sum((F.col("new") - F.col("old")) * F.col("v")).alias("change"))


def square_change(delta: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """How the squared norm moves, from the change alone."""
    new, old = F.col("new"), F.col("old")
    return delta.groupBy(*by).agg(F.sum((new - old) * (new + old)).alias("change"))
