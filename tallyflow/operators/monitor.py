"""Drift-triggered monitoring over time slices.

Sites feed a stream; an estimate kept from their sketches is refreshed only when
a local rule fires.  Spark sums each site's updates into one small sketch per time
slice, with partial aggregation; all else is joins and sums over these sketches.
Rules are checked at slice ends, so a bound may be crossed inside a slice before it is
reported; slices of one record give the per-record rule.

What happens after a refresh depends on nothing before it: the new reference is the state
of the whole stream.  So every slice is taken as a possible reference, and the next slice
at which the rule fires is searched for all of them at once, in spans that grow fourfold
for those that have found none.  The true chain of refreshes is then followed by doubling.
The number of jobs grows with the logarithm of the slices, and a slice's cells are copied
only to references whose search has come so far.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyflow.functions.scalars import KEY_BYTES, median_of, publish_bytes, relative_error, tcp_bytes, wide_product
from tallyflow.operators import guards
from tallyflow.operators.chains import reached
from tallyflow.operators.joinsize import JoinSizeQuery
from tallyflow.operators.lanes import lane_table
from tallyflow.operators.segments import Segments, positions, running_products
from tallyflow.operators.sketch import Projection, hashed, sketch
from tallyflow.session import cut_lineage


def time_slice_of(every: int) -> Column:
    """Number of the time slice of a record."""
    return F.floor(F.col("ts") / F.lit(every)).cast("bigint")


def slice_sketches(stream: DataFrame, proj: Projection, every: int, by: Sequence[str] = ("sid", "hid")) -> DataFrame:
    """Sketch of each group's updates in each slice: ``(…, slice, d, b, c)``, zero cells dropped."""
    sliced = stream.withColumn("slice", time_slice_of(every))
    freq = sliced.groupBy(*by, "slice", "key").agg(F.sum("upd").alias("cnt")).where("cnt <> 0")
    cells = hashed(freq, proj).groupBy(*by, "slice", "d", "b").agg(F.sum(F.col("sign") * F.col("cnt")).alias("c"))
    return cells.where("c <> 0")


def slice_updates(stream: DataFrame, every: int, by: Sequence[str] = ("sid", "hid")) -> DataFrame:
    """Records of each group in each slice."""
    return stream.groupBy(*by, time_slice_of(every).alias("slice")).agg(F.count(F.lit(1)).alias("updates"))


#: A slice before all others.
_BEFORE = -(2**62)
#: Slices after a reference that are looked at first, and how the span grows for those that found nothing.
FIRST_SPAN = 16
_GROWTH = 4


def numbered(slices: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """``slices`` (by…, slice, …; one row each) with their number within the group, from 1."""
    out = positions(slices, name, by=by, segments=Segments.fit(slices, ["slice"]))
    return cut_lineage(out.withColumn(name, F.col(name) + 1))


def _searched(spans: DataFrame, keys: Sequence[str], last: int, look: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``look`` says of every reference and each slice after it up to the first that fires.

    ``spans`` has keys…, a (the reference) and end (the last slice there is).  ``look`` gets
    pairs keys…, a, t and returns rows with these columns and ``fires``.  Slices after the one that fires may be there too.
    """
    keys = list(keys)
    found, span = [], FIRST_SPAN
    while True:
        stop = F.least(F.col("a") + span, F.col("end"))
        pairs = spans.where("a < end").select(*keys, "a", F.explode(F.sequence(F.col("a") + 1, stop)).alias("t"))
        seen = cut_lineage(look(pairs))
        if span >= last:
            found.append(seen)
            return reduce(DataFrame.unionByName, found)
        fired = seen.where("fires").select(*keys, "a").distinct()
        short = spans.where(F.col("a") + span < F.col("end")).join(fired, [*keys, "a"], "left_anti")
        spans = cut_lineage(short)
        found.append(seen.join(spans.select(*keys, "a"), [*keys, "a"], "left_anti"))
        span *= _GROWTH


def _next(seen: DataFrame, keys: Sequence[str], *more: str) -> DataFrame:
    """``keys…, a, b``: the first slice that fires after each reference, with other columns of that slice."""
    first = F.min(F.struct(F.col("t").alias("b"), *more)).alias("first")
    return seen.where("fires").groupBy(*keys, "a").agg(first).select(*keys, "a", "first.*")


PUBLISH_SCHEMA = T.StructType(
    [
        T.StructField("sid", T.IntegerType()),
        T.StructField("hid", T.IntegerType()),
        T.StructField("slice", T.LongType()),
        T.StructField("publication", T.LongType()),
        T.StructField("updates", T.LongType()),
        T.StructField("drift2", T.DoubleType()),
        T.StructField("cells", T.ArrayType(T.IntegerType())),
        T.StructField("values", T.ArrayType(T.LongType())),
    ]
)


def drift_publish(
    stream: DataFrame, proj: Projection, theta: float, sites: int, every: int, warm: DataFrame | None = None
) -> DataFrame:
    """Per local stream, the slices at which its drift is published.

    The drift since the last publication is published, and starts again from
    zero, once its squared norm reaches ``theta^2/sites`` of the squared norm of
    the local stream's whole sketch.  Published cells are listed sparsely.  Records of ``warm`` count as
    published before the first slice: they are part of the whole sketch and never of a drift.
    """
    key, limit = ["sid", "hid"], theta * theta / sites
    counts = numbered(slice_updates(stream, every), key, "t")
    cells = slice_sketches(stream, proj, every)
    cell = (F.col("d") * F.lit(proj.width) + F.col("b")).cast("int").alias("cell")
    # A row without change for every slice, so that none is missed.
    idle = counts.select(*key, "t", F.lit(0).alias("cell"), F.lit(0).cast("bigint").alias("c"))
    cells = cells.select(*key, "slice", cell, "c").join(counts.select(*key, "slice", "t"), [*key, "slice"]).drop("slice")
    cells = cut_lineage(cells.unionByName(idle).groupBy(*key, "t", "cell").agg(F.sum("c").alias("c")))
    ends = counts.groupBy(*key).agg(F.max("t").alias("end"))
    last = ends.agg(F.max("end")).first()[0] or 0
    lane = cells
    if warm is not None:
        start = sketch(warm, proj, key).select(*key, F.lit(0).cast("bigint").alias("t"), cell, "c")
        lane = cells.unionByName(start.where("c <> 0"))
    lane = lane.withColumn("d", F.lit(0))
    whole = running_products(lane, ["cell"], left="c", by=key, lanes=1, segments=Segments.fit(cells, ["t"]), merged=True)
    whole = cut_lineage(whole.select(*key, "t", F.col("p0").alias("total2")))

    def look(pairs: DataFrame) -> DataFrame:
        moved = pairs.join(cells, [*key, "t"])
        x = F.sum("c").over(Window.partitionBy(*key, "a", "cell").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
        grown = moved.select(*key, "a", "t", wide_product(2 * x - F.col("c"), F.col("c")).alias("g"))
        steps = grown.groupBy(*key, "a", "t").agg(F.sum("g").alias("g"))
        run = Window.partitionBy(*key, "a").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
        drift2 = F.sum("g").over(run).cast("double").alias("drift2")
        both = steps.select(*key, "a", "t", drift2).join(whole, [*key, "t"])
        return both.select(*key, "a", "t", "drift2", (F.col("drift2") >= limit * F.col("total2")).alias("fires"))

    every_slice = ends.select(*key, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("end") - 1)).alias("a"), "end")
    links = cut_lineage(_next(_searched(every_slice, key, last, look), key, "drift2"))
    chain = reached(links.select(*key, "a", "b"), ends.select(*key, F.lit(0).cast("bigint").alias("a")), key, last)
    log = links.join(chain, [*key, "a"])
    log = cut_lineage(positions(log, "publication", by=key, segments=Segments.fit(log, ["b"])))
    covered = log.select(*key, "b", F.explode(F.sequence(F.col("a") + 1, F.col("b"))).alias("t"))
    updates = covered.join(counts, [*key, "t"]).groupBy(*key, "b").agg(F.sum("updates").alias("updates"))
    sent = covered.join(cells, [*key, "t"]).groupBy(*key, "b", "cell").agg(F.sum("c").alias("c")).where("c <> 0")
    sent = sent.groupBy(*key, "b").agg(F.sort_array(F.collect_list(F.struct("cell", "c"))).alias("sent"))
    at = counts.select(*key, F.col("t").alias("b"), "slice")
    out = log.join(updates, [*key, "b"]).join(at, [*key, "b"]).join(sent, [*key, "b"], "left")
    return out.select(
        *key,
        "slice",
        (F.col("publication") + 1).alias("publication"),
        "updates",
        "drift2",
        F.coalesce("sent.cell", F.array().cast("array<int>")).alias("cells"),
        F.coalesce("sent.c", F.array().cast("array<bigint>")).alias("values"),
    )


def published_cells(published: DataFrame, proj: Projection) -> DataFrame:
    """Publications as cell changes ``(sid, hid, slice, d, b, c)``."""
    cells = published.select("sid", "hid", "slice", F.inline(F.arrays_zip("cells", "values")))
    return cells.select(
        "sid",
        "hid",
        "slice",
        F.expr(f"cells div {proj.width}").cast("int").alias("d"),
        F.expr(f"cells % {proj.width}").cast("int").alias("b"),
        F.col("values").alias("c"),
    )


def published_estimate(
    published: DataFrame, proj: Projection, segments: Segments | None = None, warm: DataFrame | None = None
) -> DataFrame:
    """The coordinator's self-join estimate after each slice with publications, from what ``warm`` told it on."""
    changes = published_cells(published, proj).groupBy("sid", "slice", "d", "b").agg(F.sum("c").alias("u"))
    if warm is not None:
        start = sketch(warm, proj).select("sid", F.lit(_BEFORE).cast("bigint").alias("slice"), "d", "b", F.col("c").alias("u"))
        changes = changes.unionByName(start.where("u <> 0"))
    seg = segments or Segments.fit(published, ["slice"])
    out = running_products(changes, ["b"], by=["sid"], lanes=proj.depth, segments=seg, merged=True)
    lanes = [F.col(f"p{d}") for d in range(proj.depth)]
    return out.where(F.col("slice") > _BEFORE).select("sid", "slice", median_of(lanes).alias("estimate"))


def publish_cost(published: DataFrame, proj: Projection, per_update: int = KEY_BYTES) -> DataFrame:
    """Messages, payload and segment bytes of a publication log, per stream."""
    payload = publish_bytes(F.col("updates"), proj.cells, per_update)
    return published.groupBy("sid").agg(
        F.count(F.lit(1)).alias("msgs"),
        F.sum("updates").alias("updates"),
        F.sum(payload).alias("bytes"),
        F.sum(tcp_bytes(payload)).alias("tcp_bytes"),
    )


# -- guarded estimates ----------------------------------------------------------

ROUND_SCHEMA = T.StructType(
    [
        T.StructField("slice", T.LongType()),
        T.StructField("round", T.LongType()),
        T.StructField("reanchored", T.BooleanType()),
        T.StructField("estimate", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("zeta_anchor", T.DoubleType()),
        T.StructField("zeta_min", T.DoubleType()),
        T.StructField("zeta_sum", T.DoubleType()),
        T.StructField("updates", T.LongType()),
        T.StructField("bytes", T.LongType()),
    ]
)

RULES = ("any_site", "sum")
_SUM_SHARE = 0.01  # fixed value of the sum rule

def monitor(
    stream: DataFrame,
    query: JoinSizeQuery,
    proj: Projection,
    sites: int,
    every: int,
    rule: str = "any_site",
    warmup_slices: int = 1,
    exact: bool = True,
    warm: DataFrame | None = None,
) -> DataFrame:
    """Per time slice: the anchored estimate, its bounds, the sites' guards and whether it re-anchored.

    ``any_site`` re-anchors when some site's guard is <= 0, ``sum`` when the sum
    of the guards falls below 1 % of ``sites`` times the anchor's guard.  The
    first ``warmup_slices`` slices set the first anchor; with ``warm``, its records do instead.
    """
    return monitor_all(stream, [query], proj, sites, every, rule, warmup_slices, exact, warm).drop("query")


def monitor_all(
    stream: DataFrame,
    queries: Sequence[JoinSizeQuery],
    proj: Projection,
    sites: int,
    every: int,
    rule: str = "any_site",
    warmup_slices: int = 1,
    exact: bool = True,
    warm: DataFrame | None = None,
) -> DataFrame:
    """``monitor`` of several queries over one pass of the stream, with column ``query`` (its text).

    Every slice is a possible anchor of the later ones.  The chain of anchors is found as
    the module describes, for all queries together.  No group is wider than one site's sketch.
    """
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}; use one of {RULES}")
    if any(proj.epsilon >= q.beta for q in queries):
        raise ValueError("total error must exceed the sketch error")
    if len({q.is_selfjoin for q in queries}) != 1:
        raise ValueError("watch self-joins and joins in calls of their own")
    run = _Monitor(proj, queries[0].is_selfjoin, sites, rule, warmup_slices if warm is None else 0, exact)
    listed = [(i, str(q), s, k, q.beta) for i, q in enumerate(queries) for k, s in enumerate(q.operands)]
    spark = stream.sparkSession
    # The declared queries; two rows each at most.
    watched = spark.createDataFrame(listed, "q int, query string, sid int, operand int, beta double")
    parts = stream.join(F.broadcast(watched.select("q", "sid", "operand")), "sid")
    slices = numbered(parts.select("q", time_slice_of(every).alias("slice")).distinct(), ["q"], "t")
    ends = slices.groupBy("q").agg(F.max("t").alias("end"))
    last = ends.agg(F.max("end")).first()[0]
    if last is None:
        return spark.createDataFrame([], ROUND_SCHEMA).withColumn("query", F.lit("")).select("query", *ROUND_SCHEMA.names)
    cells = cut_lineage(slice_sketches(parts, proj, every, ["q", "operand", "hid"]).join(slices, ["q", "slice"]).drop("slice"))
    counts = cut_lineage(slice_updates(parts, every, ["q", "hid"]).join(slices, ["q", "slice"]).drop("slice"))
    # One row per declared query.
    ends = F.broadcast(ends.join(F.broadcast(watched.select("q", "query", "beta").distinct()), "q"))
    first = None
    if warm is not None:
        first = sketch(warm.join(F.broadcast(watched.select("q", "sid", "operand")), "sid"), proj, ["q", "operand"])
    anchors = cut_lineage(run.anchors(cells, ends, first))
    every_slice = ends.select("q", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("end"))).alias("a"), "end")
    bounds = cut_lineage(run.bounds(anchors, every_slice, ends))
    norms = cut_lineage(run.norms(anchors, bounds))
    own = cut_lineage(run.zetas(norms, idle=True))
    seen = _searched(every_slice, ["q"], last, lambda pairs: run.checks(pairs, cells, anchors, norms, own, ends))
    seen = cut_lineage(seen)
    links = cut_lineage(_next(seen, ["q"]))
    chain = reached(links, ends.select("q", F.lit(0).cast("bigint").alias("a")), ["q"], last)
    chain = chain.join(links, ["q", "a"], "left")
    chain = cut_lineage(positions(chain, "rank", by=["q"], segments=Segments.fit(chain, ["a"])))
    return run.rounds(chain, seen, bounds, counts, slices, ends)


@dataclass(frozen=True)
class _Monitor:
    """The steps of a search.  ``t`` is a slice, ``a`` the slice of a possible anchor before it, 0 before the first one."""

    proj: Projection
    selfjoin: bool
    sites: int
    rule: str
    warmup: int
    exact: bool

    def anchors(self, cells: DataFrame, ends: DataFrame, first: DataFrame | None) -> DataFrame:
        """Sketch of the whole stream after every slice: ``q, a, d, b, e1`` (and ``e2``); ``first`` was there before."""
        key = ["q", "operand", "d", "b"]
        changes = cells.groupBy(*key, "t").agg(F.sum("c").alias("c"))
        if first is not None:
            changes = changes.unionByName(first.select(*key, F.lit(0).cast("bigint").alias("t"), "c"))
        changes = changes.join(ends.select("q", "end"), "q")
        w = Window.partitionBy(*key).orderBy("t")
        e = F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0))
        until = F.coalesce(F.lead("t").over(w) - 1, F.col("end"))
        held = changes.select(*key, e.alias("e"), F.sequence("t", until).alias("a")).where("e <> 0")
        return self._sides(held.select(*key, "e", F.explode("a").alias("a")), "e", ["q", "a"])

    def _sides(self, cells: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
        """Both operands side by side: value1, value2 (one side for a self-join)."""
        if self.selfjoin:
            return cells.select(*by, "d", "b", F.col(value).alias(f"{value}1"))
        zero = F.lit(0).cast("bigint")
        sums = [F.sum(F.when(F.col("operand") == k, F.col(value)).otherwise(zero)).alias(f"{value}{k + 1}") for k in (0, 1)]
        return cells.groupBy(*by, "d", "b").agg(*sums)

    def bounds(self, anchors: DataFrame, every: DataFrame, ends: DataFrame) -> DataFrame:
        """``q, a, estimate, low, high`` of every possible anchor; 0 for one without cells."""
        e1, e2 = F.col("e1"), F.col("e1" if self.selfjoin else "e2")
        dots = lane_table(anchors, self.proj.depth, {"dot": wide_product(e1, e2)}, ["q", "a"])
        known = dots.groupBy("q", "a").agg(F.median("dot").alias("estimate"))
        known = every.select("q", "a").join(known, ["q", "a"], "left").withColumn("estimate", F.coalesce("estimate", F.lit(0.0)))
        slack = (F.col("beta") - F.lit(self.proj.epsilon)) * F.abs("estimate")
        low = F.when(F.col("estimate") > 0, F.col("estimate") - slack / (1 + F.col("beta"))).otherwise(-1.0)
        high = F.when(F.col("estimate") > 0, F.col("estimate") + slack / (1 - F.col("beta"))).otherwise(1.0)
        return known.join(ends.select("q", "beta"), "q").select("q", "a", "estimate", low.alias("low"), high.alias("high"))

    def _pairs(self, one: str, two: str) -> dict[str, Column]:
        """What is squared: the sketch itself, or sum and difference of both operands."""
        if self.selfjoin:
            return {"": F.col(one)}
        return {"p": F.col(one) + F.col(two), "m": F.col(one) - F.col(two)}

    def norms(self, anchors: DataFrame, bounds: DataFrame) -> DataFrame:
        """Squared norms of every anchor by row, with its bounds: ``q, a, low, high, d, e2`` (or ``pe2, me2``)."""
        squares = {f"{k}e2": wide_product(e, e) for k, e in self._pairs("e1", "e2").items()}
        own = lane_table(anchors, self.proj.depth, squares, ["q", "a"])
        depth = F.explode(F.sequence(F.lit(0), F.lit(self.proj.depth - 1))).alias("d")
        lanes = bounds.select("q", "a", "low", "high", depth).join(own, ["q", "a", "d"], "left")
        return lanes.withColumns({n: F.coalesce(n, F.lit(0.0)) for n in squares})

    def lanes(self, pairs: DataFrame, cells: DataFrame, anchors: DataFrame, norms: DataFrame) -> DataFrame:
        """Norms by row of the state of every site at every slice in which it changes, under every anchor.

        |e + s u|^2 and (e + s u) . e grow by what each slice adds to the drift u, so a cell is
        read once per anchor and slice.
        """
        by, s = ["q", "a", "t", "hid"], F.lit(self.sites)
        steps = self._sides(pairs.join(cells, ["q", "t"]), "c", by)
        steps = steps.join(anchors, ["q", "a", "d", "b"], "left")
        sides = ("1",) if self.selfjoin else ("1", "2")
        w = Window.partitionBy("q", "a", "hid", "d", "b").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
        steps = steps.withColumns({f"e{i}": F.coalesce(f"e{i}", F.lit(0)).cast("bigint") for i in sides})
        steps = steps.withColumns({f"u{i}": F.sum(f"c{i}").over(w) for i in sides})
        c, u, e = self._pairs("c1", "c2"), self._pairs("u1", "u2"), self._pairs("e1", "e2")
        grown = {f"{k}x2": wide_product(s * c[k], 2 * e[k] + s * (2 * u[k] - c[k])) for k in c}
        grown |= {f"{k}xe": wide_product(s * c[k], e[k]) for k in c}
        run = Window.partitionBy("q", "a", "hid", "d").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
        lanes = lane_table(steps, self.proj.depth, grown, by).join(norms, ["q", "a", "d"])
        return lanes.withColumns({n: F.col(f"{n[:-2]}e2") + F.sum(n).over(run) for n in grown})

    def zetas(self, lanes: DataFrame, idle: bool = False) -> DataFrame:
        """The guard of every site at every slice under every anchor: ``q, a, t, hid, zeta``.

        With ``idle``, of the anchors themselves, from their ``norms``: ``q, a, zeta_anchor``.
        """
        by = ["q", "a"] if idle else ["q", "a", "t", "hid"]
        if idle:
            lanes = lanes.withColumns({f"{k}{x}": F.col(f"{k}e2") for k in self._pairs("e1", "e2") for x in ("x2", "xe")})
        if self.selfjoin:
            both = guards.upper_lanes(lanes, F.col("high")).withColumnsRenamed({"zx": "hx", "ze": "he"})
            both = guards.free_lower_lanes(both, F.col("low")).withColumnsRenamed({"zx": "lx", "ze": "le"})
        else:
            both = guards.inner_product_lanes(lanes, F.col("low"), True).withColumnsRenamed({"zx": "lx", "ze": "le"})
            both = guards.inner_product_lanes(both, F.col("high"), False).withColumnsRenamed({"zx": "hx", "ze": "he"})
        out = guards.quorums(both, {"zl": ("le", "lx"), "zh": ("he", "hx")}, self.proj.depth, by, exact=self.exact)
        return out.select(*by, F.least("zl", "zh").alias("zeta_anchor" if idle else "zeta"))

    def checks(
        self, pairs: DataFrame, cells: DataFrame, anchors: DataFrame, norms: DataFrame, own: DataFrame, ends: DataFrame
    ) -> DataFrame:
        """``q, a, t, zeta_anchor, zeta_min, zeta_sum, fires`` of every pair."""
        zetas = self.zetas(self.lanes(pairs, cells, anchors, norms))
        # A site keeps its guard until it changes again, or to the end of the span.
        stops = pairs.groupBy("q", "a").agg(F.max("t").alias("stop"))
        until = F.coalesce(F.lead("t").over(Window.partitionBy("q", "a", "hid").orderBy("t")) - 1, F.col("stop"))
        held = zetas.join(stops, ["q", "a"]).select("q", "a", "hid", "zeta", F.sequence("t", until).alias("t"))
        seen = held.select("q", "a", "zeta", F.explode("t").alias("t")).groupBy("q", "a", "t").agg(
            F.min("zeta").alias("least"), F.sum("zeta").alias("sum"), F.count(F.lit(1)).alias("n")
        )
        both = pairs.join(own, ["q", "a"]).join(seen, ["q", "a", "t"], "left")
        idle = F.lit(self.sites) - F.coalesce("n", F.lit(0))
        zeta_min = F.when(idle > 0, F.least("least", "zeta_anchor")).otherwise(F.col("least"))
        zeta_sum = F.coalesce("sum", F.lit(0.0)) + idle * F.col("zeta_anchor")
        both = both.withColumns({"zeta_min": zeta_min, "zeta_sum": zeta_sum})
        if self.rule == "any_site":
            rule = F.col("zeta_min") <= 0
        else:
            rule = F.col("zeta_sum") < F.lit(_SUM_SHARE * self.sites) * F.col("zeta_anchor")
        return both.select("q", "a", "t", "zeta_anchor", "zeta_min", "zeta_sum", (rule | (F.col("t") <= self.warmup)).alias("fires"))

    def rounds(
        self, chain: DataFrame, seen: DataFrame, bounds: DataFrame, counts: DataFrame, slices: DataFrame, ends: DataFrame
    ) -> DataFrame:
        """The result rows: every slice under the anchor in force."""
        size = (1 if self.selfjoin else 2) * self.proj.cells
        fired = chain.where("b is not null")
        covered = fired.select("q", F.col("b").alias("t"), F.explode(F.sequence(F.col("a") + 1, F.col("b"))).alias("s"))
        shipped = counts.withColumnRenamed("t", "s").join(covered, ["q", "s"]).groupBy("q", "t", "hid").agg(F.sum("updates").alias("updates"))
        shipped = shipped.groupBy("q", "t").agg(
            F.sum("updates").alias("updates"), F.sum(publish_bytes(F.col("updates"), size)).alias("bytes")
        )
        moved = F.col("t") == F.coalesce("b", F.lit(0))
        out = seen.drop("fires").join(chain, ["q", "a"]).where("b is null or t <= b")
        out = out.withColumns({"fired": moved, "now": F.when(moved, F.col("t")).otherwise(F.col("a"))})
        out = out.join(bounds.withColumnRenamed("a", "now"), ["q", "now"]).join(slices, ["q", "t"])
        out = out.join(shipped, ["q", "t"], "left").join(ends.select("q", "query"), "q")
        return out.select(
            "query",
            "slice",
            (F.col("rank") + F.col("fired").cast("bigint")).alias("round"),
            F.col("fired").alias("reanchored"),
            "estimate",
            "low",
            "high",
            "zeta_anchor",
            "zeta_min",
            "zeta_sum",
            F.coalesce("updates", F.lit(0)).alias("updates"),
            F.coalesce("bytes", F.lit(0)).alias("bytes"),
        )


def monitor_summaries(rounds: DataFrame, queries: Sequence[JoinSizeQuery], proj: Projection, sites: int, rule: str) -> DataFrame:
    """One result row per monitored query: rounds, checked slices, updates and bytes shipped."""
    listed = [(str(q), float(q.beta), len(q.operands) * proj.cells, q.left) for q in queries]
    watched = rounds.sparkSession.createDataFrame(listed, "run_id string, max_error double, statevec_size bigint, sid int")
    sums = rounds.groupBy(F.col("query").alias("run_id")).agg(
        F.count_if("reanchored").alias("rounds"),
        F.count(F.lit(1)).alias("subrounds"),
        F.sum("updates").alias("updates_shipped"),
        F.sum("bytes").alias("bytes_shipped"),
    )
    return sums.join(F.broadcast(watched), "run_id").select(
        "run_id",
        F.lit(rule).alias("protocol"),
        "max_error",
        "statevec_size",
        F.lit(sites).alias("sites"),
        "sid",
        "rounds",
        "subrounds",
        "updates_shipped",
        "bytes_shipped",
    )


def monitor_summary(rounds: DataFrame, query: JoinSizeQuery, proj: Projection, sites: int, rule: str) -> DataFrame:
    """The same of ``monitor`` for one query."""
    return monitor_summaries(rounds.withColumn("query", F.lit(str(query))), [query], proj, sites, rule)


def error_series(exact: DataFrame, estimated: DataFrame, on: Sequence[str], value: str = "estimate") -> DataFrame:
    """Join two series on their time key and add the relative error of the second."""
    e = exact.select(*on, F.col(value).alias("exact"))
    s = estimated.select(*on, F.col(value).alias("approx"))
    return e.join(s, list(on)).withColumn("rel_error", relative_error(F.col("exact"), F.col("approx")))
