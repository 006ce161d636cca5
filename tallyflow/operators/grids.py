"""Parameter grids as DataFrames."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.operators.segments import Segments, positions


def param(spark: SparkSession, name: str, values: Iterable) -> DataFrame:
    """One column with one row per value."""
    return spark.createDataFrame([(v,) for v in values], [name])


def values_of(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """The distinct values of a column as a parameter."""
    return df.select(F.col(column).alias(name or column)).distinct()


def cross(a: DataFrame, b: DataFrame, *more: DataFrame) -> DataFrame:
    """Every setting of each grid with every setting of the others; on a shared name the later grid wins.

    The result is a product by definition, and has as many rows.
    """
    keep = [c for c in a.columns if c not in b.columns]
    both = a.select(*keep).crossJoin(b)
    return cross(both, *more) if more else both


def numbered(grid: DataFrame, order: Sequence[str], name: str = "_i") -> DataFrame:
    """Add the 0-based place of each row in the given order."""
    return positions(grid, name, segments=Segments.fit(grid, order))


def zip_with(a: DataFrame, b: DataFrame, order_a: Sequence[str], order_b: Sequence[str]) -> DataFrame:
    """Pair the rows of two equally long grids by place; a single row pairs with all."""
    na, nb = a.count(), b.count()
    if na == 1 or nb == 1:
        return cross(a, b)
    if na != nb:
        raise ValueError("zip_with pairs rows by position, so both grids need the same number of rows")
    x = numbered(a, order_a)
    y = numbered(b, order_b)
    shared = [c for c in a.columns if c in b.columns]
    return x.drop(*shared).join(y, "_i").drop("_i")


def _as_settings(grids: Sequence[DataFrame]) -> list[Column]:
    """The settings of each grid as one struct; the structs have all grids' parameters, NULL where a grid lacks one."""
    fields = {f.name: f.dataType for grid in reversed(grids) for f in grid.schema.fields}
    return [
        F.struct(*[(F.col(c) if c in grid.columns else F.lit(None)).cast(t).alias(c) for c, t in fields.items()]) for grid in grids
    ]


def cross_listed(name: str, *grids: DataFrame) -> DataFrame:
    """One parameter with a list of settings, one of each grid, in every combination; as many rows as the product."""
    first, *rest = [g.select(F.array(s).alias(f"_{i}")) for i, (g, s) in enumerate(zip(grids, _as_settings(grids), strict=True))]
    for other in rest:
        first = first.crossJoin(other)
    return first.select(F.concat(*first.columns).alias(name))


def zip_listed(name: str, *grids: tuple[DataFrame, Sequence[str]]) -> DataFrame:
    """One parameter with a list of settings, one of each (grid, order) at the same place, up to the shortest grid's end."""
    settings = _as_settings([g for g, _ in grids])
    out = None
    for i, ((grid, order), setting) in enumerate(zip(grids, settings, strict=True)):
        placed = numbered(grid, order).select("_i", setting.alias(f"_{i}"))
        out = placed if out is None else out.join(placed, "_i")
    return out.select(F.array(*[c for c in out.columns if c != "_i"]).alias(name))


def concat(a: DataFrame, b: DataFrame) -> DataFrame:
    """One grid after the other; parameters that one lacks are NULL there."""
    return a.unionByName(b, allowMissingColumns=True)


def select(grid: DataFrame, condition: Column) -> DataFrame:
    return grid.where(condition)


def where_param(grid: DataFrame, name: str, condition) -> DataFrame:
    """Rows that have the parameter and meet the condition on it."""
    if name not in grid.columns:
        return grid.limit(0)
    return grid.where(F.col(name).isNotNull() & condition(F.col(name)))


def with_param(grid: DataFrame, name: str) -> DataFrame:
    return grid.where(F.col(name).isNotNull()) if name in grid.columns else grid.limit(0)


def without_param(grid: DataFrame, name: str) -> DataFrame:
    return grid.where(F.col(name).isNull()) if name in grid.columns else grid


def project(grid: DataFrame, **columns: Column) -> DataFrame:
    """Set parameters from expressions over the others."""
    return grid.withColumns(columns)


def drop_param(grid: DataFrame, *names: str) -> DataFrame:
    return grid.drop(*names)


def nest(grid: DataFrame, name: str) -> DataFrame:
    """Each setting as one struct column."""
    return grid.select(F.struct(*grid.columns).alias(name))
