"""Predicates for picking rows of result tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Predicate = Callable[[Column], Column]


def less_than(x) -> Predicate:
    return lambda c: c < x


def less_equal(x) -> Predicate:
    return lambda c: c <= x


def greater_than(x) -> Predicate:
    return lambda c: c > x


def greater_equal(x) -> Predicate:
    return lambda c: c >= x


def not_equal(x) -> Predicate:
    return lambda c: c != x


def like(pattern: str) -> Predicate:
    return lambda c: c.like(pattern)


def not_like(pattern: str) -> Predicate:
    return lambda c: ~c.like(pattern)


def between(low, high) -> Predicate:
    return lambda c: c.between(low, high)


def approx(x: float, eps: float = 1e-4) -> Predicate:
    """Relative closeness to x, absolute closeness where x is 0."""
    if x == 0:
        return lambda c: F.abs(c) <= eps
    return lambda c: F.abs(c / F.lit(float(x)) - 1) <= eps


def all_of(*preds: Predicate) -> Predicate:
    return lambda c: reduce(lambda p, q: p & q, [pred(c) for pred in preds])


def any_of(*preds: Predicate) -> Predicate:
    return lambda c: reduce(lambda p, q: p | q, [pred(c) for pred in preds])


def matches(where: Mapping[str, object] | Sequence[tuple[str, object]]) -> Column:
    """Conjunction of column conditions: a predicate, a list (IN) or a value (=)."""
    items = list(where.items()) if isinstance(where, Mapping) else list(where)

    def one(name, value):
        c = F.col(name)
        if callable(value):
            return value(c)
        if isinstance(value, (list, tuple, set)):
            return c.isin(list(value))
        return c == value

    return reduce(lambda p, q: p & q, [one(n, v) for n, v in items], F.lit(True))
