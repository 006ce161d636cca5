"""Chains of levels over series of any length.

A row leaves the band ``p*|level| + d`` around the last level and becomes the next one, so what
a row does depends on all rows before it.  Yet a stretch of a series needs only one number
from before, the level in force when it begins, and that is found without running through
the stretches one after the other:

* The series are cut into segments by (group, order).  Only a group that crosses a border of
  segments needs more than its own run of rows.
* Whatever level is in force, the first row of a run that leaves its band is a *record*: the
  smallest or the largest so far in the run.  From there on the run's chain is fixed, so each
  record has one *end level*, found for all rows at once by next exits (a tree of minima and
  maxima) and pointer doubling.
* The next exit from an end level lies in the first later run whose minimum or maximum leaves the band,
  found by doubling over runs, at the first such record.  These links make a forest of
  records; the chain from the start of the group is marked in it by doubling again.

Then every run is filtered on its own, from the level in force at its start.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyflow.operators.chains import reached
from tallyflow.operators.segments import Segments
from tallyflow.schema import order_columns
from tallyflow.session import cut_lineage


def leaves(low: np.ndarray, high: np.ndarray, level: np.ndarray, p: float, d: float) -> np.ndarray:
    """Whether one of the values between which ``low`` and ``high`` are the extremes is outside the band."""
    width = p * np.abs(level) + d
    return (high - level > width) | (level - low > width)


def level_hits(values: np.ndarray, last: float | None, p: float, d: float, step: int = 1024) -> tuple[list[int], float | None]:
    """Places that leave the band around the last level, and the last level after them.

    Looks for the next such place in whole stretches of the array.
    """
    hits: list[int] = []
    at = 0
    if last is None and len(values):
        last, at = float(values[0]), 1
    while at < len(values):
        stretch = values[at : at + step]
        out = np.abs(stretch - last) > p * abs(last) + d
        i = int(out.argmax())
        if not out[i]:
            at += len(stretch)
            continue
        hits.append(at + i)
        last = float(stretch[i])
        at += i + 1
    return hits, last


def next_exits(values: np.ndarray, p: float, d: float) -> np.ndarray:
    """For every place the next one outside the band around its value; the length where there is none."""
    n = len(values)
    lows, highs = [values], [values]
    while len(lows[-1]) > 1:
        low, high = lows[-1], highs[-1]
        if len(low) % 2:
            low, high = np.append(low, low[-1]), np.append(high, high[-1])
        lows.append(np.minimum(low[::2], low[1::2]))
        highs.append(np.maximum(high[::2], high[1::2]))
    out = np.full(n, n)
    open_ = np.arange(n)
    at = open_ + 1
    height = np.zeros(n, dtype=np.int64)
    base = np.cumsum([0, *map(len, lows)])
    low, high = np.concatenate(lows), np.concatenate(highs)
    size = np.array([len(x) for x in lows])
    while True:
        inside = at < size[height]
        open_, at, height = open_[inside], at[inside], height[inside]
        if not len(open_):
            return out
        node = base[height] + at
        found = leaves(low[node], high[node], values[open_], p, d)
        leaf = found & (height == 0)
        out[open_[leaf]] = at[leaf]
        # Down into a node with an exit; past a node without, and up where its parent is whole.
        down = found & ~leaf
        at = np.where(down, 2 * at, np.where(found, at, at + 1))
        up = ~found & (at % 2 == 0)
        at = np.where(up, at // 2, at)
        height = height - down + up
        top = height >= len(size)
        keep = ~leaf & ~top
        open_, at, height = open_[keep], at[keep], height[keep]


def record_ends(values: np.ndarray, p: float, d: float) -> tuple[np.ndarray, np.ndarray]:
    """Places that are smaller or larger than all before, and the last level of the chain from each."""
    n = len(values)
    low, high = np.minimum.accumulate(values), np.maximum.accumulate(values)
    new = np.ones(n, dtype=bool)
    new[1:] = (low[1:] < low[:-1]) | (high[1:] > high[:-1])
    ahead = np.append(next_exits(values, p, d), n)
    ahead = np.where(ahead == n, np.arange(n + 1), ahead)
    while True:
        further = ahead[ahead]
        if (further == ahead).all():
            break
        ahead = further
    records = np.flatnonzero(new)
    return records, values[ahead[records]]


#: Of every run at a border of segments: its extremes, and per record its value and end level.
_RUN = "_s0 bigint, low double, high double, place array<bigint>, value array<double>, ends array<double>"


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, list[pa.RecordBatch]]]:
    """Re-cut ordered batches into runs of equal first ``keys`` columns: a row with the key, and the parts."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, dtype=bool)
        for c in range(keys):
            column = batch.column(c)
            a, b = column.slice(0, batch.num_rows - 1), column.slice(1)
            differs = pc.not_equal(a, b)
            differs = pc.fill_null(differs, False).to_numpy(zero_copy_only=False)
            nulls = column.is_null().to_numpy(zero_copy_only=False)
            new[1:] |= differs | (nulls[1:] != nulls[:-1])
        if held and any(held[0].column(c)[0].as_py() != batch.column(c)[0].as_py() for c in range(keys)):
            yield held[0].slice(0, 1), held
            held = []
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            if held and begin:
                yield held[0].slice(0, 1), held
                held = []
            held.append(batch.slice(begin, end - begin))
    if held:
        yield held[0].slice(0, 1), held


def _by_segment(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    return rows.repartition(F.col("_s0")).sortWithinPartitions("_s0", *by, *order)


def border_runs(tagged: DataFrame, by: list[str], order: list[str], p: float, d: float) -> DataFrame:
    """Every run of a group that crosses a border of segments, with its records.

    Columns ``by…, _s0, low, high, place, value, ends``.
    """
    # A run is looked at if its group has another one; these are two per segment at most.
    pieces = tagged.groupBy(*by, "_s0").agg(F.count(F.lit(1)).alias("n"))
    groups = pieces.groupBy(*by).agg(F.count(F.lit(1)).alias("runs")).where("runs > 1").drop("runs")
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"g.{c}")) for c in by]
    crossing = tagged.select(*by, "_s0", *order, "level").alias("t").join(groups.alias("g"), same, "left_semi") if by else tagged
    placed = _by_segment(crossing.select("_s0", *by, *order, "level"), by, order)
    schema = T.StructType([*[tagged.schema[c] for c in by], *T._parse_datatype_string(_RUN).fields])
    keys = 1 + len(by)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, parts in _runs(batches, keys):
            values = np.concatenate([b.column(b.num_columns - 1).to_numpy(zero_copy_only=False) for b in parts])
            records, ends = record_ends(values, p, d)
            lists = [pa.array([x.tolist()], pa.list_(t)) for x, t in ((records, pa.int64()), (values[records], pa.float64()), (ends, pa.float64()))]
            yield pa.RecordBatch.from_arrays(
                [key.column(1 + i) for i in range(len(by))] + [key.column(0), pa.array([values.min()]), pa.array([values.max()]), *lists],
                names=[*by, "_s0", "low", "high", "place", "value", "ends"],
            )

    return placed.mapInArrow(summarise, schema)


def _equal(a: str, b: str, columns: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out &= F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def _outside(low: str, high: str, level: str, p: float, d: float) -> Column:
    width = p * F.abs(F.col(level)) + d
    return (F.col(high) - F.col(level) > width) | (F.col(level) - F.col(low) > width)


def next_runs(nodes: DataFrame, runs: DataFrame, by: list[str], count: int, p: float, d: float) -> DataFrame:
    """``nodes`` (by…, run, level) with ``target``: the first later run that has a row outside the band.

    Extremes of 1, 2, 4, … consecutive runs; a node skips the largest stretch without an exit
    first, so each power is one join on the place reached.
    """
    powers = [runs.select(*by, "run", "low", "high")]
    for k in range(1, max(count - 1, 1).bit_length()):
        half = powers[-1]
        behind = half.select(*by, (F.col("run") - (1 << (k - 1))).alias("run"), F.col("low").alias("low2"), F.col("high").alias("high2"))
        joined = half.alias("a").join(behind.alias("b"), _equal("a", "b", [*by, "run"]), "left")
        powers.append(joined.select(*[F.col(f"a.{c}").alias(c) for c in [*by, "run"]], F.least("low", "low2").alias("low"), F.greatest("high", "high2").alias("high")))
    out = nodes.withColumn("target", F.col("run") + 1)
    columns = out.columns
    for k in reversed(range(len(powers))):
        part = powers[k].select(*by, F.col("run").alias("target"), "low", "high")
        out = out.alias("a").join(part.alias("b"), _equal("a", "b", [*by, "target"]), "left")
        quiet = F.col("low").isNotNull() & ~_outside("low", "high", "level", p, d)
        out = out.select(*[F.col(f"a.{c}").alias(c) for c in columns[:-1]], F.when(quiet, F.col("a.target") + (1 << k)).otherwise(F.col("a.target")).alias("target"))
    # One more look: the last stretch skipped may end before a run without exit.
    part = powers[0].select(*by, F.col("run").alias("target"), "low", "high")
    out = out.alias("a").join(part.alias("b"), _equal("a", "b", [*by, "target"]), "left")
    hit = F.col("low").isNotNull() & _outside("low", "high", "level", p, d)
    return out.select(*[F.col(f"a.{c}").alias(c) for c in columns[:-1]], F.when(hit, F.col("a.target")).alias("target"))


def entry_levels(runs: DataFrame, by: list[str], first: DataFrame | float | None, p: float, d: float) -> DataFrame:
    """``by…, _s0, entry``: the level in force when each of ``border_runs`` begins; null where there is none yet."""
    number = F.row_number().over(Window.partitionBy(*by, *([] if by else [F.lit(0)])).orderBy("_s0")).cast("bigint") - 1
    runs = cut_lineage(runs.withColumn("run", number))
    count = runs.agg(F.max("run")).head()[0]
    if count is None:
        return runs.select(*by, "_s0", F.lit(None).cast("double").alias("entry"))
    records = runs.select(*by, "run", F.inline(F.arrays_zip("place", "value", "ends")))
    # Nodes: every record by its end level, and a start of its own where a first level is given.
    nodes = records.select(*by, "run", "place", F.col("ends").alias("level"))
    root = nodes.where("run = 0 and place = 0")
    if first is not None:
        begins = runs.where("run = 0").select(*by)
        if isinstance(first, DataFrame):
            given = begins.alias("a").join(first.alias("b"), _equal("a", "b", by)).select(*[F.col(f"a.{c}").alias(c) for c in by], "first")
        else:
            given = begins.withColumn("first", F.lit(float(first)))
        start = given.select(*by, F.lit(-1).cast("bigint").alias("run"), F.lit(0).cast("bigint").alias("place"), F.col("first").alias("level"))
        nodes = nodes.unionByName(start)
        root = start.unionByName(root.alias("a").join(given.alias("b"), _equal("a", "b", by), "left_anti"))
    aimed = next_runs(nodes, runs, by, count + 2, p, d).where("target is not null")
    # The first record of the target outside the band.  Along a run's records both extremes only grow,
    # so the place is found by bisection in the run's arrays.
    asks = aimed.groupBy(*by, "target").agg(F.collect_list(F.struct("run", "place", "level")).alias("asks"))
    lists = runs.select(*by, F.col("run").alias("target"), F.col("place").alias("places"), "value")
    met = asks.alias("a").join(lists.alias("b"), _equal("a", "b", [*by, "target"])).select(*[F.col(f"a.{c}").alias(c) for c in [*by, "target"]], "asks", "places", "value")
    schema = T.StructType([*[runs.schema[c] for c in by], *T._parse_datatype_string("run bigint, place bigint, to_run bigint, to_place bigint").fields])
    at = len(by)

    def bisect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                asked = batch.column(at + 1)[row].values
                level = asked.field("level").to_numpy(zero_copy_only=False)
                value = batch.column(at + 3)[row].values.to_numpy(zero_copy_only=False)
                low, high = np.minimum.accumulate(value), np.maximum.accumulate(value)
                a, b = np.zeros(len(level), dtype=np.int64), np.full(len(level), len(value) - 1)
                while (a < b).any():
                    middle = (a + b) >> 1
                    out = leaves(low[middle], high[middle], level, p, d)
                    a, b = np.where(out, a, middle + 1), np.where(out, middle, b)
                places = batch.column(at + 2)[row].values.to_numpy(zero_copy_only=False)
                one = pa.array(np.full(len(level), row))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).take(one) for i in range(at)]
                    + [asked.field("run"), asked.field("place"), batch.column(at).take(one), pa.array(places[a])],
                    names=[*by, "run", "place", "to_run", "to_place"],
                )

    links = cut_lineage(met.mapInArrow(bisect, schema))
    group = F.struct(*by).alias("g") if by else F.struct(F.lit(0).alias("all")).alias("g")
    here, there = F.struct("run", "place").alias("a"), F.struct(F.col("to_run").alias("run"), F.col("to_place").alias("place")).alias("b")
    # A link leads to a later run, so there are no more than runs.
    chain = reached(links.select(group, here, there), root.select(group, here), ["g"], count + 1)
    passed = chain.join(nodes.select(*by, group, here, "level"), ["g", "a"]).select(*by, F.col("a.run").alias("run"), "level")
    both = runs.select(*by, "run", "_s0").unionByName(passed.groupBy(*by, "run").agg(F.max("level").alias("level")), allowMissingColumns=True)
    merged = both.groupBy(*by, "run").agg(F.max("_s0").alias("_s0"), F.max("level").alias("level"))
    w = Window.partitionBy(*by, *([] if by else [F.lit(0)])).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    return merged.withColumn("entry", F.last("level", ignorenulls=True).over(w)).where("_s0 is not null").select(*by, "_s0", "entry")


def level_chain(
    series: DataFrame, value: str, p: float, d: float, by: Sequence[str], first: DataFrame | float | None, segments: Segments | None = None
) -> DataFrame:
    """Rows that become levels: ``by…, order…, level``.  See ``sampling.level_changed``.

    ``first`` may be a table (by…, first) of the levels in force before; groups it lacks begin with their first value.
    """
    by, order = list(by), order_columns(series)
    slim = series.select(*by, *order, F.col(value).cast("double").alias("level")).where("level is not null and not isnan(level)")
    tagged = (segments or Segments.fit(slim, [*by, *order])).tag(slim)
    entries = entry_levels(border_runs(tagged, by, order, p, d), by, first, p, d)
    # The level at the start of a run travels before the run's rows.
    carried = entries.where("entry is not null").select("_s0", *by, F.lit(0).alias("_live"), F.col("entry").alias("level"))
    start = first
    if isinstance(first, DataFrame):
        heads = tagged.groupBy(*by).agg(F.min("_s0").alias("_s0"))
        heads = heads.alias("a").join(first.alias("b"), _equal("a", "b", by))
        given = heads.select("_s0", *[F.col(f"a.{c}").alias(c) for c in by], F.lit(0).alias("_live"), F.col("first").alias("level"))
        carried, start = carried.unionByName(given).dropDuplicates(["_s0", *by]), None
    both = tagged.withColumn("_live", F.lit(1)).unionByName(carried, allowMissingColumns=True)
    placed = both.repartition(F.col("_s0")).sortWithinPartitions("_s0", *by, "_live", *order)
    names = [*by, *order, "level"]
    keys = 1 + len(by)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            for begin, end in _stretches(batch, keys):
                now = tuple(batch.column(c)[begin].as_py() for c in range(keys))
                if now != key:
                    key, last = now, start
                part = batch.slice(begin, end - begin)
                values = part.column(part.num_columns - 1).to_numpy(zero_copy_only=False)
                live = part.column(keys)[0].as_py()
                if not live:
                    last, part, values = float(values[0]), part.slice(1), values[1:]
                hits, last = level_hits(values, last, p, d)
                if hits:
                    yield part.select(names).take(pa.array(hits))

    schema = T.StructType([slim.schema[c] for c in names])
    return placed.select("_s0", *by, "_live", *order, "level").mapInArrow(emit, schema)


def _stretches(batch: pa.RecordBatch, keys: int) -> Iterator[tuple[int, int]]:
    """Begin and end of the stretches of equal keys in an ordered batch."""
    new = np.zeros(batch.num_rows, dtype=bool)
    for c in range(keys):
        column = batch.column(c)
        differs = pc.fill_null(pc.not_equal(column.slice(0, batch.num_rows - 1), column.slice(1)), False)
        nulls = column.is_null().to_numpy(zero_copy_only=False)
        new[1:] |= differs.to_numpy(zero_copy_only=False) | (nulls[1:] != nulls[:-1])
    cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
    return zip(cuts, cuts[1:], strict=False)
