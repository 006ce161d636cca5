"""Guard values: how far a site's sketch is inside the region where the estimate is safe.

A guard value >= 0 means that the site cannot, by itself, move the estimate out
of its bounds.  ``sites`` and ``anchor`` are sketches ``(…, d, b, c)``; an anchor
has at most D*L rows and is broadcast.  Row-wise guards are combined over the D
rows by a quorum: the median is safe if a majority of rows is.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyflow.functions import guard_math
from tallyflow.functions.scalars import wide_product
from tallyflow.operators.lanes import lane_table
from tallyflow.operators.sketch import Projection

MAX_BROADCAST_CELLS = 2_000_000
_SQRT_HALF = math.sqrt(0.5)


def _small(cells: DataFrame, proj: Projection, groups: int = 1) -> DataFrame:
    """Broadcast a sketch table only within its D*L bound; else let Spark shuffle it."""
    return F.broadcast(cells) if proj.cells * groups <= MAX_BROADCAST_CELLS else cells


def majority(depth: int) -> int:
    return (depth + 1) // 2


def site_states(
    anchor: DataFrame, drift: DataFrame, sites: int, site: str = "hid", group: Sequence[str] = ()
) -> DataFrame:
    """State of every site (of every ``group``): the anchor plus ``sites`` times its drift.

    Scaled this way, the mean of the site states is the state of the whole stream.
    The anchor (at most D*L rows a group) is repeated for each site id seen in the drift.
    """
    hosts = drift.select(*group, site).distinct()
    if group:
        everywhere = hosts.join(anchor, list(group)).select(site, *anchor.columns)
    else:
        everywhere = anchor.select(F.explode(hosts.agg(F.collect_list(site)).scalar()).alias(site), *anchor.columns)
    keys = [c for c in everywhere.columns if c not in ("c", "c1", "c2")]
    values = [c for c in anchor.columns if c in ("c", "c1", "c2")]
    scaled = drift.withColumns({v: F.col(v) * sites for v in values})
    return everywhere.unionByName(scaled).groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])


# -- self-join guards ---------------------------------------------------------


def site_lanes(
    sites: DataFrame, anchor: DataFrame, proj: Projection, by: Sequence[str], group: Sequence[str] = ()
) -> DataFrame:
    """Per site and row: ``x2`` = |X_d|^2, ``xe`` = X_d . E_d, and ``e2`` = |E_d|^2 of the anchor (of the ``group``)."""
    e = anchor.select(*group, "d", "b", F.col("c").alias("_e"))
    joined = sites.join(e if group else _small(e, proj), [*group, "d", "b"], "left")
    x = F.col("c")
    lanes = lane_table(
        joined, proj.depth, {"x2": wide_product(x, x), "xe": wide_product(x, F.col("_e"))}, by
    )
    norms = lane_table(anchor, proj.depth, {"e2": wide_product(x, x)}, group)
    return lanes.join(norms, [*group, "d"]) if group else lanes.join(F.broadcast(norms), "d")


def guard_ball(anchor_guard: Column, drift_norm: Column) -> Column:
    """Safe while the drift stays in the ball of radius zeta(E)."""
    return anchor_guard - drift_norm


def upper_lanes(lanes: DataFrame, high: Column) -> DataFrame:
    return lanes.withColumns(
        {"zx": F.sqrt(high) - F.sqrt("x2"), "ze": F.sqrt(high) - F.sqrt("e2")}
    )


def lower_lanes(lanes: DataFrame, low: Column) -> DataFrame:
    root = F.sqrt(F.greatest(low, F.lit(0.0)))
    along = F.when(F.col("e2") > 0, F.col("xe") / F.sqrt("e2")).otherwise(0.0)
    return lanes.withColumns({"zx": along - root, "ze": F.sqrt("e2") - root})


def guard_selfjoin_upper(
    lanes: DataFrame, high: Column, proj: Projection, by: Sequence[str], exact: bool = True
) -> DataFrame:
    return quorum(upper_lanes(lanes, high), proj.depth, by, exact=exact)


def free_lower_lanes(lanes: DataFrame, low: Column) -> DataFrame:
    """``lower_lanes``, with guard +infinity where the bound is not positive and cannot be crossed."""
    free = low <= 0
    return lower_lanes(lanes, low).withColumns(
        {"zx": F.when(free, F.lit(float("inf"))).otherwise(F.col("zx")), "ze": F.when(free, 1.0).otherwise(F.col("ze"))}
    )


def _column(value: Column | float) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def guard_selfjoin_lower(
    lanes: DataFrame, low: Column | float, proj: Projection, by: Sequence[str], exact: bool = True
) -> DataFrame:
    """+infinity where the lower bound is not positive."""
    return quorum(free_lower_lanes(lanes, _column(low)), proj.depth, by, exact=exact)


def guard_selfjoin(
    lanes: DataFrame, low: Column | float, high: Column | float, proj: Projection, by: Sequence[str], exact: bool = True
) -> DataFrame:
    """The smaller of the two guards, with both: one pass over the lanes."""
    both = upper_lanes(lanes, _column(high)).withColumnsRenamed({"zx": "hx", "ze": "he"})
    both = free_lower_lanes(both, _column(low))
    out = quorums(both, {"zeta_low": ("ze", "zx"), "zeta_high": ("he", "hx")}, proj.depth, by, exact=exact)
    return out.withColumn("zeta", F.least("zeta_low", "zeta_high"))


# -- quorum -------------------------------------------------------------------


def _subsets(spark: SparkSession, depth: int, k: int) -> DataFrame:
    """``_l, _mask``: for each number l of legal rows, the sets of l-k+1 of them as bit masks."""
    masks = spark.range(1 << depth).select(F.col("id").alias("_mask"), F.explode(F.sequence(F.lit(k), F.lit(depth))).alias("_l"))
    fits = (F.bit_count("_mask") == F.col("_l") - F.lit(k - 1)) & (F.col("_mask") < F.pow(F.lit(2), F.col("_l")))
    return masks.where(fits)


def _total(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)


def _ratio(legal: Column, mask: Column) -> Column:
    """Normalised sum over the chosen rows."""
    chosen = F.transform(legal, lambda r, i: F.struct(r["ze"].alias("ze"), r["zx"].alias("zx"), F.getbit(mask, i).alias("on")))
    chosen = F.filter(chosen, lambda r: r["on"] == 1)
    scale = F.sqrt(_total(F.transform(chosen, lambda r: r["ze"] * r["ze"])))
    return _total(F.transform(chosen, lambda r: r["ze"] * r["zx"])) / scale


def _legal(lanes: Column, ze: str, zx: str) -> Column:
    pairs = F.transform(lanes, lambda r: F.struct(r[ze].alias("ze"), r[zx].alias("zx")))
    return F.filter(pairs, lambda r: r["ze"] > 0)


def quorums(
    lanes: DataFrame,
    guards: Mapping[str, tuple[str, str]],
    depth: int,
    by: Sequence[str] = (),
    k: int | None = None,
    exact: bool = True,
) -> DataFrame:
    """Combine per-row guards into one value per group, for several guards at once.

    ``guards`` maps an output column to its (anchor, site) columns in ``lanes``.  A
    group has at most D lanes.  Exact: the smallest normalised
    ``sum(ze*zx)/sqrt(sum(ze^2))`` over all subsets of l-k+1 of the l rows with
    ze > 0, whose number doubles with each row.  Fast: the sum of the l-k+1 smallest ``ze*zx``, of the same sign.
    """
    k = majority(depth) if k is None else k
    columns = list(dict.fromkeys(c for pair in guards.values() for c in pair))
    out = lanes.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("d", *columns))).alias("_lanes"))
    out = out.withColumns({f"_{g}": _legal(F.col("_lanes"), *pair) for g, pair in guards.items()})
    short = F.raise_error(F.lit(f"a quorum of {k} needs as many rows with a positive reference value"))
    for g in guards:
        legal, n = F.col(f"_{g}"), F.size(f"_{g}")
        checked = F.when(n >= k, n).otherwise(short.cast("int"))
        if not exact:
            products = F.sort_array(F.transform(legal, lambda r: r["ze"] * r["zx"]))
            out = out.withColumn(g, _total(F.slice(products, F.lit(1), checked - F.lit(k - 1))))
        else:
            out = out.withColumn("_l", checked)
            chosen = out.join(_subsets(lanes.sparkSession, depth, k), "_l")
            values = chosen.groupBy(*by).agg(F.min(_ratio(legal, F.col("_mask"))).alias(g))
            out = out.drop("_l").join(values, list(by)) if by else out.drop("_l").withColumn(g, values.scalar())
    return out.select(*by, *guards)


def quorum(lanes: DataFrame, depth: int, by: Sequence[str] = (), k: int | None = None, exact: bool = True) -> DataFrame:
    """Combine columns ``ze`` (anchor) and ``zx`` (site) into one ``zeta`` per group."""
    return quorums(lanes, {"zeta": ("ze", "zx")}, depth, by, k, exact)


def quorum_fast(lanes: DataFrame, k: int, by: Sequence[str] = (), depth: int = 0) -> DataFrame:
    return quorum(lanes, depth, by, k, exact=False)


def quorum_exact(lanes: DataFrame, depth: int, k: int, by: Sequence[str] = ()) -> DataFrame:
    return quorum(lanes, depth, by, k, exact=True)


# -- bilinear guards ----------------------------------------------------------


@F.pandas_udf(T.DoubleType())
def _bilinear(xi: pd.Series, psi: pd.Series, t: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series(guard_math.bilinear(xi, psi, t, x, y))


def guard_bilinear(xi: Column, psi: Column, t: Column, x: Column, y: Column) -> Column:
    """Guard for x^2 - y^2 >= t around the reference (xi, psi).

    The distance to a hyperbola has no closed form that SQL functions offer, so
    it is found by Newton steps on whole Arrow batches.
    """
    return _bilinear(*[c.cast("double") for c in (xi, psi, t, x, y)])


def polarised_lanes(
    sites: DataFrame, anchor: DataFrame, proj: Projection, by: Sequence[str], depth: int | None = None
) -> DataFrame:
    """Per site and row: norms and products of X1+X2, X1-X2 with the anchor's.

    ``sites`` and ``anchor`` hold both operands as columns ``c1`` and ``c2``.
    Columns: ``px2``/``mx2`` = |X1 +- X2|^2, ``pxe``/``mxe`` = dot with the
    anchor's E1 +- E2, ``pe2``/``me2`` = |E1 +- E2|^2.
    """
    depth = proj.depth if depth is None else depth
    e = anchor.select("d", "b", (F.col("c1") + F.col("c2")).alias("_p"), (F.col("c1") - F.col("c2")).alias("_m"))
    x = sites.withColumns({"_xp": F.col("c1") + F.col("c2"), "_xm": F.col("c1") - F.col("c2")})
    joined = x.join(_small(e, proj), ["d", "b"], "left")
    w = wide_product
    lanes = lane_table(
        joined,
        depth,
        {
            "px2": w(F.col("_xp"), F.col("_xp")),
            "mx2": w(F.col("_xm"), F.col("_xm")),
            "pxe": w(F.col("_xp"), F.col("_p")),
            "mxe": w(F.col("_xm"), F.col("_m")),
        },
        by,
    )
    norms = lane_table(e, depth, {"pe2": w(F.col("_p"), F.col("_p")), "me2": w(F.col("_m"), F.col("_m"))})
    return lanes.join(F.broadcast(norms), "d")


def _along(dot: Column, norm2: Column) -> Column:
    return F.when(norm2 > 0, dot / F.sqrt(norm2)).otherwise(0.0)


def _pair_guard(t: Column, geq: bool, xe: str, e2: str, other_e2: str, other_x2: str) -> tuple[Column, Column]:
    """Guard at the site and at the anchor for one bound of a product of two vectors."""
    bound = 4 * t if geq else -4 * t
    xi, psi = F.sqrt(F.col(e2)), F.sqrt(F.col(other_e2))
    at_site = guard_bilinear(xi, psi, bound, _along(F.col(xe), F.col(e2)), F.sqrt(F.col(other_x2)))
    at_anchor = guard_bilinear(xi, psi, bound, xi, psi)
    return at_site * _SQRT_HALF, at_anchor * _SQRT_HALF


def inner_product_lanes(lanes: DataFrame, t: Column, geq: bool = True) -> DataFrame:
    """Per row: ``zx``/``ze`` for X1.X2 >= t (or <= t)."""
    if geq:
        zx, ze = _pair_guard(t, True, "pxe", "pe2", "me2", "mx2")
    else:
        zx, ze = _pair_guard(t, False, "mxe", "me2", "pe2", "px2")
    return lanes.withColumns({"zx": zx, "ze": ze})


def guard_inner_product(
    sites: DataFrame, anchor: DataFrame, proj: Projection, t: float, by: Sequence[str], geq: bool = True
) -> DataFrame:
    """Guard for the product of two whole vectors: their cells form one lane.

    An all-zero reference direction is replaced by the diagonal for t >= 0.
    """
    one = lambda df: df.withColumn("b", F.col("d") * F.lit(proj.width) + F.col("b")).withColumn("d", F.lit(0))
    lanes = polarised_lanes(one(sites), one(anchor), proj, by, depth=1)
    x1, x2 = F.col("c1").cast("double"), F.col("c2").cast("double")
    main = (x1 + x2) if geq else (x1 - x2)
    diag = sites.groupBy(*by).agg((F.sum(main) / F.lit(math.sqrt(proj.cells))).alias("_diag"))
    lanes = lanes.join(diag, list(by))
    bound = F.lit(4.0 * t if geq else -4.0 * t)
    e2, other_e2 = ("pe2", "me2") if geq else ("me2", "pe2")
    xe, other_x2 = ("pxe", "mx2") if geq else ("mxe", "px2")
    empty = F.when(bound < 0, F.lit(0.0)).otherwise(F.col("_diag"))
    along = F.when(F.col(e2) > 0, F.col(xe) / F.sqrt(e2)).otherwise(empty)
    value = guard_bilinear(F.sqrt(e2), F.sqrt(other_e2), bound, along, F.sqrt(other_x2)) * _SQRT_HALF
    return lanes.select(*by, value.alias("zeta"))


def guard_join(
    lanes: DataFrame, low: float, high: float, proj: Projection, by: Sequence[str], exact: bool = True
) -> DataFrame:
    """Guard for low <= join estimate <= high, from :func:`polarised_lanes`."""
    if not low < high:
        raise ValueError("the lower bound must be below the upper one")
    low_lanes = inner_product_lanes(lanes, F.lit(low), True).withColumnsRenamed({"zx": "lx", "ze": "le"})
    both = inner_product_lanes(low_lanes, F.lit(high), False)
    out = quorums(both, {"zeta_low": ("le", "lx"), "zeta_high": ("ze", "zx")}, proj.depth, by, exact=exact)
    return out.withColumn("zeta", F.least("zeta_low", "zeta_high"))


# -- pluggable guards -------------------------------------------------------------


class Guard(Protocol):
    """What a monitor needs: one ``zeta`` per site, from site states and the anchor.

    Both are cells ``(…, operand, d, b, c)``; operand is 0 or 1.
    """

    def zeta(self, sites: DataFrame, anchor: DataFrame, by: Sequence[str]) -> DataFrame: ...


def _pair(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Both operands side by side as c1, c2."""
    zero = F.lit(0).cast("bigint")
    sides = [F.sum(F.when(F.col("operand") == i, F.col("c")).otherwise(zero)).alias(f"c{i + 1}") for i in (0, 1)]
    return cells.groupBy(*by, "d", "b").agg(*sides)


@dataclass(frozen=True)
class SelfjoinGuard:
    """Keeps low <= self-join estimate <= high."""

    proj: Projection
    low: float
    high: float
    exact: bool = True

    def zeta(self, sites: DataFrame, anchor: DataFrame, by: Sequence[str]) -> DataFrame:
        lanes = site_lanes(sites.drop("operand"), anchor.drop("operand"), self.proj, by)
        return guard_selfjoin(lanes, self.low, self.high, self.proj, by, self.exact)


@dataclass(frozen=True)
class JoinGuard:
    """Keeps low <= join estimate <= high."""

    proj: Projection
    low: float
    high: float
    exact: bool = True

    def zeta(self, sites: DataFrame, anchor: DataFrame, by: Sequence[str]) -> DataFrame:
        lanes = polarised_lanes(_pair(sites, by), _pair(anchor, []), self.proj, by)
        return guard_join(lanes, self.low, self.high, self.proj, by, self.exact)
