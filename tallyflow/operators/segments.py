"""Order-dependent operators without a single-task stage.

A stream is cut into *segments*: contiguous runs of its order ``(ts, kind, seq)``.
Work that needs "everything before this row" is then done in two levels:

1. totals per segment (partial aggregation, tiny shuffle) and their prefix sums;
2. a window inside each segment, started from the prefix that is carried in.

The carried values travel as extra rows of the same shuffle, so the rows move
once and no join is needed.  Segments are the partitions of a range partitioning
by the whole order, whose bounds Spark samples from the rows themselves: a crowded
time, an outlier or a skewed id leaves them as even as any other stream.  The
tagged rows are written once to the shared folder, so that every later use sees
the same segments and the source is read once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyflow.functions.scalars import wide_product
from tallyflow.schema import order_columns
from tallyflow.session import cut_lineage

#: Rows of a segment that one task should hold.
TARGET_ROWS = 1_000_000


@dataclass(frozen=True)
class Segments:
    """Into how many segments a stream is cut, and by which order."""

    order: tuple[str, ...]
    pieces: int = 1

    @classmethod
    def fit(
        cls,
        df: DataFrame,
        order: Sequence[str] | None = None,
        target_rows: int = TARGET_ROWS,
        least: int | None = None,
    ) -> Segments:
        """As many segments as ``target_rows`` asks for, and at least enough to use all cores."""
        order = tuple(order or order_columns(df))
        n = df.select(*order).count()
        if least is None:
            least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return cls(order, max(1, min(n, least), math.ceil(n / target_rows)))

    @property
    def columns(self) -> list[str]:
        return ["_s0"]

    def tag(self, df: DataFrame, together: bool = False) -> DataFrame:
        """``df`` with its segment number ``_s0``, written to the shared folder.

        Rows that the order does not tell apart are parted at random, unless they are to
        stay ``together``.
        """
        ties = [] if together else [F.rand(7)]
        ranged = df.repartitionByRange(self.pieces, *self.order, *ties)
        return cut_lineage(ranged.withColumn("_s0", F.spark_partition_id().cast("bigint")))


def _window(by: Sequence[str], order: Sequence[str]) -> Window:
    spec = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return spec.orderBy(*order)


def before(totals: DataFrame, by: Sequence[str], seg: Segments, values: Sequence[str]) -> DataFrame:
    """Replace per-segment totals by the sums over all earlier segments.

    Works on the table of totals; a window sees at most one row per segment.
    """
    w = _window(by, seg.columns).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumns({v: F.coalesce(F.sum(v).over(w), F.lit(0)) for v in values})


def running_sums(
    df: DataFrame,
    sums: Mapping[str, Column],
    by: Sequence[str] = (),
    segments: Segments | None = None,
) -> DataFrame:
    """Add running totals of ``sums`` per group ``by``, inclusive of the current row."""
    return running_groups(df, [(list(by), sums)], segments)


def running_groups(
    df: DataFrame,
    specs: Sequence[tuple[Sequence[str], Mapping[str, Column]]],
    segments: Segments | None = None,
) -> DataFrame:
    """Running totals for several groupings at once: ``[(by, {name: expression}), …]``.

    The rows are shuffled once, by segment, whatever the number of groupings.
    """
    seg = segments or Segments.fit(df)
    s, names = seg.columns, [n for _, sums in specs for n in sums]
    rows = seg.tag(df.withColumns({f"_v_{n}": e.cast("bigint") for _, sums in specs for n, e in sums.items()}))
    both = rows.withColumn("_live", F.lit(1))
    for by, sums in specs:
        values = [f"_v_{n}" for n in sums]
        totals = rows.groupBy(*by, *s).agg(*[F.sum(v).alias(v) for v in values])
        carry = before(totals, by, seg, values).where(" or ".join(f"`{v}` <> 0" for v in values))
        both = both.unionByName(carry.withColumn("_live", F.lit(0)), allowMissingColumns=True)
    if len(specs) > 1:
        both = both.repartition(*[F.col(c) for c in s])
    out = {}
    for by, sums in specs:
        w = Window.partitionBy(*s, *by).orderBy("_live", *seg.order)
        out |= {n: F.sum(f"_v_{n}").over(w.rowsBetween(Window.unboundedPreceding, 0)) for n in sums}
    return both.withColumns(out).where("_live = 1").select(*df.columns, *names)


def positions(
    df: DataFrame, name: str = "pos", by: Sequence[str] = (), segments: Segments | None = None
) -> DataFrame:
    """Add the 0-based position of each row in stream order, overall or per group."""
    out = running_sums(df, {name: F.lit(1)}, by, segments)
    return out.withColumn(name, F.col(name) - 1)


def previous_values(
    df: DataFrame,
    columns: Mapping[str, str],
    by: Sequence[str] = (),
    segments: Segments | None = None,
) -> DataFrame:
    """Add, as ``columns[c]``, the value of ``c`` on the preceding row of the group (NULL on the first).

    The last row of each segment is carried into the group's next non-empty segment.
    """
    seg = segments or Segments.fit(df)
    rows = seg.tag(df)
    payload = F.struct(*[F.col(c) for c in columns])
    last = rows.groupBy(*by, *seg.columns).agg(
        F.max_by(payload, F.struct(*seg.order)).alias("_last")
    )
    handed = last.withColumn("_last", F.lag("_last").over(_window(by, seg.columns))).where("_last is not null")
    handed = handed.select(*by, *seg.columns, "_last.*", F.lit(0).alias("_live"))
    both = rows.withColumn("_live", F.lit(1)).unionByName(handed, allowMissingColumns=True)
    w = Window.partitionBy(*seg.columns, *by).orderBy("_live", *seg.order)
    out = both.withColumns({new: F.lag(old).over(w) for old, new in columns.items()})
    return out.where("_live = 1").select(*df.columns, *columns.values())


def running_products(
    rows: DataFrame,
    slot: Sequence[str],
    left: str = "u",
    right: str | None = None,
    by: Sequence[str] = (),
    lanes: int = 0,
    segments: Segments | None = None,
    expand: Callable[[DataFrame], DataFrame] = lambda df: df,
    merged: bool = False,
) -> DataFrame:
    """After every update: sum over slots of (running left) * (running right), per lane.

    ``expand`` turns ``rows`` into one row per update and slot, with the slot's
    signed changes in ``left`` and ``right`` (one stream against itself if
    ``right`` is None).  With ``lanes`` > 0, slots carry a lane number ``d`` and
    each update gets one product per lane: columns ``p0..``; without lanes an
    update has one slot and one product, ``p0``.

    The change of a segment telescopes per slot, so the totals come from the
    (slot, segment) table, which is summed per key before it is expanded.  The rows
    are shuffled once, by segment, and expanded only after that.  Products are exact
    up to 38 digits.  Rows with the same order are updates of their own, or together
    one update if ``merged``.
    """
    seg = segments or Segments.fit(rows)
    by, slot, s, order = list(by), list(slot), seg.columns, list(seg.order)
    sides = [left] if right is None else [left, right]
    a, b = sides[0], sides[-1]
    n = max(lanes, 1)
    lane = ["d"] if lanes else []
    group = list(dict.fromkeys([*by, *slot, *lane]))
    by_segment = [F.col(c) for c in s]
    tagged = seg.tag(rows, together=merged)

    def per_lane(column, name):
        return [F.sum(F.when(F.col("d") == i, column) if lanes else column).alias(f"{name}{i}") for i in range(n)]

    # State of every slot at the start of each segment that touches it.
    named = [c for c in rows.columns if c not in (*order, *sides)]
    per_key = tagged.groupBy(*named, *s).agg(*[F.sum(c).alias(c) for c in sides])
    totals = expand(per_key).groupBy(*group, *s).agg(*[F.sum(c).alias(c) for c in sides])
    states = before(totals.withColumns({f"_t_{c}": F.col(c) for c in sides}), group, seg, sides)

    # Products at the start of each segment.
    grown = wide_product(F.col(a) + F.col(f"_t_{a}"), F.col(b) + F.col(f"_t_{b}")) - wide_product(F.col(a), F.col(b))
    changes = states.withColumn("_g", grown).groupBy(*by, *s).agg(*per_lane(F.col("_g"), "_b"))
    bases = before(changes, by, seg, [f"_b{i}" for i in range(n)])

    carry = states.drop(*[f"_t_{c}" for c in sides]).where(" or ".join(f"`{c}` <> 0" for c in sides))
    numbered = tagged.withColumn("_row", F.lit(0) if merged else F.monotonically_increasing_id())
    moved = expand(numbered.repartition(*by_segment)).select(*group, *order, *sides, *s, "_row")
    live = moved.withColumn("_live", F.lit(1)).unionByName(
        carry.withColumn("_live", F.lit(0)).repartition(*by_segment), allowMissingColumns=True
    )
    w = Window.partitionBy(*s, *group).orderBy("_live", *order, "_row").rowsBetween(Window.unboundedPreceding, 0)
    after = live.withColumns({f"_a_{c}": F.sum(c).over(w) for c in sides}).where("_live = 1")
    now_a, now_b = F.col(f"_a_{a}"), F.col(f"_a_{b}")
    if right is None:
        step = wide_product(2 * now_a - F.col(a), F.col(a))
    else:
        step = wide_product(now_a, F.col(b)) + wide_product(F.col(a), now_b - F.col(b))
    after = after.withColumn("_step", step)
    if lanes:
        # One row per update; the rows are grouped by segment already.
        updates = after.groupBy(*s, *by, *order, "_row").agg(*per_lane(F.col("_step"), "_p"))
    else:
        updates = after.select(*s, *by, *order, "_row", F.col("_step").alias("_p0"))

    anchored = updates.withColumn("_live", F.lit(1)).unionByName(
        bases.withColumn("_live", F.lit(0)).repartition(*by_segment), allowMissingColumns=True
    )
    run = Window.partitionBy(*s, *by).orderBy("_live", *order, "_row").rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0).cast("decimal(38,0)")
    estimates = {
        f"p{i}": (F.coalesce(F.sum(f"_b{i}").over(run), zero) + F.coalesce(F.sum(f"_p{i}").over(run), zero)).cast("double")
        for i in range(n)
    }
    out = anchored.withColumns(estimates).where("_live = 1")
    return out.select(*by, *order, *[f"p{i}" for i in range(n)])
