"""AGMS sketches as long tables ``(…, d, b, c)``.

A sketch has D rows of L counters.  Row d adds ``sign_d(key) * upd`` to counter
``bucket_d(key)``.  A group has at most D*L rows, however long its stream is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyflow.functions.mixing import MASK31, fold_key, hash31, seed31
from tallyflow.functions.scalars import median_of, relative_error, wide_product
from tallyflow.operators.frequency import frequency_vector
from tallyflow.operators.lanes import lane_table
from tallyflow.operators.joinsize import _sided, selfjoin_size
from tallyflow.operators.segments import Segments, running_products

# How each hash family folds the high bits, and its sign bit.
FAMILIES = {"xor": 15, "sum": 0}


@dataclass(frozen=True)
class Projection:
    """Depth, width and hash seeds of a family of compatible sketches."""

    depth: int = 7
    width: int = 1500
    seed: int = 1
    epsilon_override: float | None = None
    family: str = "xor"

    def __post_init__(self):
        if self.depth < 1 or self.width < 1:
            raise ValueError("depth and width must be positive")
        if self.family not in FAMILIES:
            raise ValueError(f"unknown hash family {self.family!r}")

    @property
    def cells(self) -> int:
        return self.depth * self.width

    @property
    def epsilon(self) -> float:
        return 4.0 / math.sqrt(self.width) if self.epsilon_override is None else self.epsilon_override

    @property
    def failure_probability(self) -> float:
        return 0.5 ** (self.depth / 2)

    def seeds(self) -> list[tuple[int, ...]]:
        """Per row: its number and six seeds in [1, 2**31 - 2]."""
        return [(d, *[seed31(self.seed, d, i) for i in range(6)]) for d in range(self.depth)]

    def seeds_literal(self) -> Column:
        rows = [
            F.struct(F.lit(d).alias("d"), *[F.lit(f).cast("bigint").alias(f"_f{i}") for i, f in enumerate(fs)])
            for d, *fs in self.seeds()
        ]
        return F.array(*rows)

    def compatible(self, other: Projection) -> bool:
        mine, theirs = ((p.depth, p.width, p.seed, p.family) for p in (self, other))
        return mine == theirs


def hashed(df: DataFrame, proj: Projection) -> DataFrame:
    """One row per sketch row d, with bucket ``b`` and ``sign`` (+1/-1) of ``key``."""
    out = df.select("*", F.inline(proj.seeds_literal())).withColumn("_x", fold_key(F.col("key")))
    x = F.col("_x")
    f = [F.col(f"_f{i}") for i in range(6)]
    fold = lambda a, b, v: hash31(a, b, v, proj.family)
    bucket = F.pmod(fold(f[0], f[1], x), F.lit(proj.width).cast("bigint")).cast("int")
    mixed = fold(fold(fold(x, f[2], f[3]), x, f[4]), x, f[5])
    bit = F.shiftright(mixed, FAMILIES[proj.family]).bitwiseAND(F.lit(1).cast("bigint"))
    out = out.withColumns({"b": bucket, "sign": 2 * bit - 1})
    return out.drop("_x", *[f"_f{i}" for i in range(6)])


def sketch(stream: DataFrame, proj: Projection, by: Sequence[str] = ("sid",)) -> DataFrame:
    """Sketch of every group: key counts first, so hashing works on distinct keys."""
    freq = frequency_vector(stream, by).where("cnt <> 0")
    return sketch_counts(freq, proj, by)


def sketch_counts(freq: DataFrame, proj: Projection, by: Sequence[str] = ("sid",)) -> DataFrame:
    cells = hashed(freq, proj)
    mark = {_MARK: f"{proj.depth} x {proj.width}, seed {proj.seed}, family {proj.family}"}
    return cells.groupBy(*by, "d", "b").agg(F.sum(F.col("sign") * F.col("cnt")).alias("c", metadata=mark))


#: Metadata key of counters: the projection they belong to.
_MARK = "projection"


def _mark(*sketches: DataFrame) -> dict[str, str]:
    """The projection that sketches are marked with; different ones cannot be combined."""
    marks = {m for m in (s.schema["c"].metadata.get(_MARK) for s in sketches if "c" in s.columns) if m}
    if len(marks) > 1:
        raise ValueError(f"sketches of different projections do not combine: {sorted(marks)}")
    return {_MARK: marks.pop()} if marks else {}


def _counters(value: Column, mark: dict[str, str]) -> Column:
    return value.alias("c", metadata=mark)


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    return _collapse(a.unionByName(b), _mark(a, b))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return add(a, scale(b, -1))


def merge(sketches: DataFrame, drop: Sequence[str]) -> DataFrame:
    """Sum sketches over the dropped group columns (e.g. hosts)."""
    return _collapse(sketches.drop(*drop), _mark(sketches))


def _collapse(cells: DataFrame, mark: dict[str, str]) -> DataFrame:
    keys = [c for c in cells.columns if c != "c"]
    return cells.groupBy(*keys).agg(_counters(F.sum("c"), mark))


def scale(a: DataFrame, by: int | float) -> DataFrame:
    return a.select(*[c for c in a.columns if c != "c"], _counters(F.col("c") * F.lit(by), _mark(a)))


def divide(a: DataFrame, by: int | float) -> DataFrame:
    return a.select(*[c for c in a.columns if c != "c"], _counters(F.col("c") / F.lit(by), _mark(a)))


def blend(a: DataFrame, b: DataFrame, weight: float) -> DataFrame:
    """Move ``a`` towards ``b`` by ``weight`` (exponential smoothing)."""
    part_a = a.withColumn("c", F.col("c") * F.lit(1.0 - weight))
    part_b = b.withColumn("c", F.col("c") * F.lit(weight))
    return _collapse(part_a.unionByName(part_b), _mark(a, b))


def differing_cells(a: DataFrame, b: DataFrame) -> DataFrame:
    """Number of cells in which two sketches differ (0 means equal)."""
    return subtract(a, b).agg(F.count_if(F.col("c") != 0).alias("differing"))


def row_dots(a: DataFrame, b: DataFrame, proj: Projection, by: Sequence[str] = ()) -> DataFrame:
    """Dot product of each pair of sketch rows: ``(…, d, dot)``, zero rows included."""
    _mark(a, b)
    x = a.select(*by, "d", "b", F.col("c").alias("_x"))
    y = b.select(*by, "d", "b", F.col("c").alias("_y"))
    cells = x.join(y, [*by, "d", "b"], "full")
    return lane_table(cells, proj.depth, {"dot": wide_product(F.col("_x"), F.col("_y"))}, by)


def row_squares(sk: DataFrame, proj: Projection, by: Sequence[str] = ("sid",), name: str = "_r") -> DataFrame:
    """One row per group with the squared norm of every sketch row."""
    squares = wide_product(F.col("c"), F.col("c"))
    return sk.groupBy(*by).agg(
        *[
            F.coalesce(F.sum(F.when(F.col("d") == d, squares)), F.lit(0)).cast("double").alias(f"{name}{d}")
            for d in range(proj.depth)
        ]
    )


def selfjoin_estimate(sk: DataFrame, proj: Projection, by: Sequence[str] = ("sid",)) -> DataFrame:
    """Median over rows of the squared row norm."""
    rows = row_squares(sk, proj, by)
    return rows.select(*by, median_of([F.col(f"_r{d}") for d in range(proj.depth)]).alias("estimate"))


def join_estimate(a: DataFrame, b: DataFrame, proj: Projection, by: Sequence[str] = ()) -> DataFrame:
    """Median over rows of the row dot products."""
    dots = row_dots(a, b, proj, by)
    return dots.groupBy(*by).agg(F.median("dot").alias("estimate"))


def selfjoin_estimate_running(stream: DataFrame, proj: Projection, segments: Segments | None = None) -> DataFrame:
    """Self-join estimate of each stream after every update."""
    seg = segments or Segments.fit(stream)
    rows = stream.select("sid", "key", *seg.order, F.col("upd").alias("u"))
    signed = lambda df: hashed(df, proj).withColumn("u", F.col("sign") * F.col("u"))
    out = running_products(rows, ["b"], by=["sid"], lanes=proj.depth, segments=seg, expand=signed)
    return _with_median(out, proj)


def join_estimate_running(
    stream: DataFrame, left: int, right: int, proj: Projection, segments: Segments | None = None
) -> DataFrame:
    """Join estimate of two streams after every update of either."""
    if left == right:
        one = stream.where(F.col("sid") == left)
        return selfjoin_estimate_running(one, proj, segments).drop("sid")
    pair = _sided(stream, left, right)
    seg = segments or Segments.fit(pair)
    rows = pair.select("key", *seg.order, "u1", "u2")
    signed = lambda df: hashed(df, proj).withColumns({u: F.col("sign") * F.col(u) for u in ("u1", "u2")})
    out = running_products(rows, ["b"], "u1", "u2", lanes=proj.depth, segments=seg, expand=signed)
    return _with_median(out, proj)


def _with_median(out: DataFrame, proj: Projection) -> DataFrame:
    lanes = [f"p{d}" for d in range(proj.depth)]
    return out.withColumn("estimate", median_of([F.col(p) for p in lanes])).drop(*lanes)


def point_estimate(sk: DataFrame, keys: DataFrame, proj: Projection, by: Sequence[str] = ("sid",)) -> DataFrame:
    """Estimated count of each (group, key) row of ``keys``: median of its signed counters."""
    probes = hashed(keys.select(*by, "key"), proj)
    hit = probes.join(sk, [*by, "d", "b"], "left")
    value = F.coalesce(F.col("sign") * F.col("c"), F.lit(0))
    lanes = hit.groupBy(*by, "key").agg(
        *[F.sum(F.when(F.col("d") == d, value)).cast("double").alias(f"_r{d}") for d in range(proj.depth)]
    )
    return lanes.select(*by, "key", median_of([F.col(f"_r{d}") for d in range(proj.depth)]).alias("estimate"))


def sketch_norm(sk: DataFrame, by: Sequence[str] = ("sid",)) -> DataFrame:
    """Squared norm and norm over all cells."""
    out = sk.groupBy(*by).agg(F.sum(wide_product(F.col("c"), F.col("c"))).cast("double").alias("norm2"))
    return out.withColumn("norm", F.sqrt("norm2"))


def accuracy(stream: DataFrame, proj: Projection) -> DataFrame:
    """Exact and estimated self-join size per stream, relative error and whether it is within epsilon.

    Both come from the same key counts: the raw stream is aggregated once.
    """
    exact = selfjoin_size(stream).withColumnRenamed("selfjoin", "exact")
    est = selfjoin_estimate(sketch(stream, proj), proj)
    err = relative_error(F.col("exact"), F.col("estimate"))
    return exact.join(est, "sid").withColumns({"rel_error": err, "within": err <= F.lit(proj.epsilon)})


def seeds_table(spark, proj: Projection) -> DataFrame:
    """The seeds as a table, for export."""
    fields = [T.StructField("d", T.IntegerType())] + [T.StructField(f"f{i}", T.LongType()) for i in range(6)]
    return spark.createDataFrame(proj.seeds(), T.StructType(fields))


def _lane(proj: Projection, d: int):
    """NumPy function: keys -> hash of row d whose remainder by the width is the bucket, and sign (+1/-1)."""
    f, mask, sign_bit = np.array(proj.seeds()[d][1:], dtype=np.int64), MASK31, FAMILIES[proj.family]

    def fold(a, b, x):
        r = a * x + b
        high = r >> 31
        return ((high ^ r) if proj.family == "xor" else (high + r)) & mask

    def lane(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.mod(key, mask)
        h = fold(fold(fold(x, f[2], f[3]), x, f[4]), x, f[5])
        return fold(f[0], f[1], x), 2 * ((h >> sign_bit) & 1) - 1

    return lane


def counters(proj: Projection):
    """NumPy function (keys, counts) -> D x L counters."""
    lanes = [_lane(proj, d) for d in range(proj.depth)]

    def count(key: np.ndarray, upd: np.ndarray) -> np.ndarray:
        out = np.zeros((proj.depth, proj.width), dtype=np.int64)
        for row, lane in zip(out, lanes, strict=True):
            h, sign = lane(key)
            np.add.at(row, h % proj.width, sign * upd)
        return out

    return count


def agms_udaf(proj: Projection):
    """Grouped-aggregate function (key, upd) -> flat array of D*L counters, for ad-hoc use.

    Convenient in ``groupBy().agg``, but it gathers each group in one task; use
    :func:`sketch` for anything large.
    """
    count = counters(proj)

    @F.pandas_udf("array<bigint>")
    def agms(key: pd.Series, upd: pd.Series) -> list:
        return count(key.to_numpy(np.int64), upd.to_numpy(np.int64)).ravel().tolist()

    return agms


def selfjoin_estimates(parts: DataFrame, projections: Sequence[Projection], by: Sequence[str]) -> DataFrame:
    """Exact and estimated self-join size of every group under many projections: ``by…, n, exact, depth, width, estimate``.

    For many groups with keys from a small domain of numbers from 0: a row of ``parts`` holds some
    ``keys`` of a group and their ``counts``, as arrays, and the rows of a group add up.  Each group
    is shuffled once.  Row d of all projections of a seed has the same hashes, so they are computed once.
    """
    by, families = list(by), {}
    for p in projections:
        families.setdefault((p.seed, p.family), []).append(p)
    shared = []
    for some in families.values():
        deepest = max(some, key=lambda p: p.depth)
        widths = {w: max(p.depth for p in some if p.width == w) for w in {p.width for p in some}}
        shared.append((some, widths, [_lane(deepest, d) for d in range(deepest.depth)]))
    more = "n bigint, exact double, depth int, width int, estimate double"
    schema = T.StructType([*[parts.schema[c] for c in by], *T._parse_datatype_string(more).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, group = np.zeros(0, dtype=np.int64), None
        for batch in batches:
            group = group or [batch.column(c).slice(0, 1) for c in by]
            key, cnt = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("keys", "counts"))
            total = np.pad(total, (0, max(0, int(key.max(initial=-1)) + 1 - len(total))))
            np.add.at(total, key, cnt)
        key = np.flatnonzero(total)
        cnt = total[key].astype(np.float64)
        n, exact, rows = int(total.sum()), float(cnt @ cnt), []
        for some, widths, lanes in shared:
            norms = {w: [] for w in widths}
            for d, lane in enumerate(lanes):
                h, sign = lane(key)
                signed = sign * cnt
                for w in (w for w, depth in widths.items() if d < depth):
                    c = np.bincount(h % w, signed)
                    norms[w].append(float(c @ c))
            rows += [(n, exact, p.depth, p.width, float(np.median(norms[p.width][: p.depth]))) for p in some]
        columns = [pa.array(g.to_pylist() * len(rows), g.type) for g in group]
        kinds = (pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.float64())
        columns += [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    # By number: the work of a group goes with its keys and sizes, not with its bytes.
    tasks = 4 * parts.sparkSession.sparkContext.defaultParallelism
    return parts.repartition(tasks, *by).groupBy(*by).applyInArrow(run, schema)
