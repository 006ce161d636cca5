"""Scalar column functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the message cost model.
TCP_HEADER_BYTES = 40
TCP_SEGMENT_BYTES = 1024
CELL_BYTES = 4
UPDATE_BYTES = 8
KEY_BYTES = 4


def square(x: Column) -> Column:
    return x * x


def cube(x: Column) -> Column:
    return x * x * x


def sign(x: Column) -> Column:
    return F.signum(x).cast("int")


def relative_error(exact: Column, estimate: Column) -> Column:
    """|exact - estimate| / |exact|; the estimate itself where exact is 0."""
    return F.when(exact == 0, estimate.cast("double")).otherwise(F.abs((exact - estimate) / exact))


def wide_product(a: Column, b: Column) -> Column:
    """Exact product of two 64-bit integers; its sum stays exact far past 2**63."""
    return a.cast("decimal(19,0)") * b.cast("decimal(19,0)")


def median_of(cols: Sequence[Column]) -> Column:
    """Median over a fixed list of columns of one row."""
    ordered, n = F.sort_array(F.array(*cols)), len(cols)
    upper = F.element_at(ordered, n // 2 + 1)
    return upper if n % 2 else (F.element_at(ordered, n // 2) + upper) / 2


def tcp_bytes(payload: Column) -> Column:
    """Payload plus one header per started segment."""
    segments = F.ceil(payload / F.lit(TCP_SEGMENT_BYTES))
    return (payload + segments * F.lit(TCP_HEADER_BYTES)).cast("bigint")


def publish_bytes(updates: Column, cells: int, per_update: int = UPDATE_BYTES) -> Column:
    """A sketch is shipped as cells or as raw updates, whichever is smaller."""
    return F.least(F.lit(CELL_BYTES * cells).cast("bigint"), (updates * F.lit(per_update)).cast("bigint"))
