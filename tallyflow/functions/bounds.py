"""Error bounds and sketch sizing, on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sketch_epsilon(width: Column) -> Column:
    return F.lit(4.0) / F.sqrt(width)


def failure_probability(depth: Column) -> Column:
    return F.pow(F.sqrt(F.lit(0.5)), depth)


def publish_error_bound(epsilon: Column, theta: Column) -> Column:
    """Total error of the published estimate for sketch error epsilon and drift ratio theta."""
    return epsilon + F.pow(1 + epsilon, 2) * (2 * theta + theta * theta)


def publish_sizing(beta: Column, gamma: Column, sites: Column, epsilon: Column) -> dict[str, Column]:
    """Depth, width and drift ratio that meet error beta with failure probability gamma."""
    return {
        "depth": F.ceil(2 * F.log2(2 * sites / gamma)).cast("bigint"),
        "width": F.ceil(16 / (epsilon * epsilon)).cast("bigint"),
        "theta": F.sqrt(1 + (beta - epsilon) / F.pow(1 + epsilon, 2)) - 1,
    }


def guard_sizing(gamma: Column, epsilon: Column) -> dict[str, Column]:
    return {
        "depth": F.ceil(2 * F.log(1 / gamma)).cast("bigint"),
        "width": F.ceil(16 / (epsilon * epsilon)).cast("bigint"),
    }


def admissible_low(estimate: Column, beta: float, epsilon: float) -> Column:
    _check(beta, epsilon)
    return F.when(estimate > 0, estimate - F.lit(beta - epsilon) * F.abs(estimate) / F.lit(1 + beta)).otherwise(-1.0)


def admissible_high(estimate: Column, beta: float, epsilon: float) -> Column:
    _check(beta, epsilon)
    return F.when(estimate > 0, estimate + F.lit(beta - epsilon) * F.abs(estimate) / F.lit(1 - beta)).otherwise(1.0)


def drift_ratio(beta: float, epsilon: float) -> float:
    _check(beta, epsilon)
    return (beta - epsilon) / (1 - beta * beta)


def _check(beta: float, epsilon: float) -> None:
    if epsilon >= beta:
        raise ValueError("total error must exceed the sketch error")
