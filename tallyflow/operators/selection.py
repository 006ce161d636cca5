"""The record at a position of the stream order, found by narrowing its order key.

Each pass counts the records by equal stretches of one order column, between the bounds
known so far, and keeps the stretch that holds the position; a few passes over the order columns
alone find the key.  Cuts by position are then filters with a bound on the leading column,
which reaches the scan: the stream is neither sorted, numbered nor copied.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.schema import order_columns

#: Stretches counted in one pass; the driver sees so many numbers.
STRETCHES = 4096


@dataclass(frozen=True)
class Place:
    """Order key of a record, and how many records with the very same key come before it."""

    order: tuple[str, ...]
    key: tuple[int, ...]
    before: int

    def earlier(self) -> Column:
        """Whether a record has a smaller key; the leading column is bounded by itself."""
        *rest, last = range(len(self.order))
        smaller = F.col(self.order[last]) < self.key[last]
        for i in reversed(rest):
            c = F.col(self.order[i])
            smaller = (c < self.key[i]) | ((c == self.key[i]) & smaller)
        return (F.col(self.order[0]) <= self.key[0]) & smaller

    def equal(self) -> Column:
        out = F.lit(True)
        for name, value in zip(self.order, self.key, strict=True):
            out &= F.col(name) == value
        return out


def place_of(stream: DataFrame, position: int, order: Sequence[str] | None = None) -> Place | None:
    """The place of the record at a 0-based position; None beyond the end.  Order columns hold integers."""
    order = tuple(order or order_columns(stream))
    keys, rank, found = stream.select(*order), position, []
    for name in order:
        c = F.col(name)
        low, high, n = keys.agg(F.min(name), F.max(name), F.count(F.lit(1))).first()
        if rank >= n:
            return None
        while low < high:
            width = (high - low) // STRETCHES + 1
            stretch = F.expr(f"(CAST(`{name}` AS DECIMAL(20,0)) - ({low})) div {width}")
            between = keys.where((c >= low) & (c <= high))
            for k, n in sorted(between.groupBy(stretch.alias("k")).count().collect()):
                if rank < n:
                    break
                rank -= n
            low, high = low + k * width, min(high, low + (k + 1) * width - 1)
        found.append(low)
        keys = keys.where(c == low)
    return Place(order, tuple(found), rank)


def between_positions(stream: DataFrame, start: int, end: int) -> DataFrame:
    """Records at positions start … end - 1 of the stream order.

    Records that the order does not tell apart may take each other's places.
    """
    if end <= start:
        return stream.where("false")
    first = place_of(stream, start) if start > 0 else None
    if start > 0 and first is None:
        return stream.where("false")
    last = place_of(stream, end)
    if first is None:
        if last is None:
            return stream
        head = stream.where(last.earlier())
        return head.unionByName(stream.where(last.equal()).limit(last.before)) if last.before else head
    if last is not None and last.key == first.key:
        return stream.where(first.equal()).limit(end - start)
    inside = ~first.earlier() & (F.col(first.order[0]) >= first.key[0])
    if last is not None:
        inside &= last.earlier()
    if not first.before:
        out = stream.where(inside)
    else:
        equal = stream.where(first.equal())
        out = stream.where(inside & ~first.equal()).unionByName(equal.limit(equal.count() - first.before))
    return out.unionByName(stream.where(last.equal()).limit(last.before)) if last is not None and last.before else out
