"""Whitening of embeddings by spectrum slicing of their covariance.

Sums and the covariance are partial sums of the partitions, added by Spark; the driver holds
them only as numbers per dimension and per pair of dimensions, so their size is bounded by
``MAX_DIMS``.  Every leading component is bracketed by a task of its own, and every cluster of
close ones refined and certified by another.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.llm import spectrum

#: Components returned, from the largest variance down.
COMPONENTS = 32
#: The integer grid of the entries.
SCALE, OFFSET = 64, 1_000_000
#: Longest vectors taken: a covariance of this size has 128 MB.
MAX_DIMS = 4096
#: Entries beyond this size have no exact place on the grid.
_LARGEST = float(1 << 46)

WHITENED = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double"


@dataclass
class Fit:
    """Count, sums, eigenvalues, eigenvectors (columns) and trace of one fit list."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def on_grid(embeddings: DataFrame) -> DataFrame:
    """``vec_id, x`` of the usable rows: ``x = floor(64 c) + 1000000`` of every entry, as longs.

    Rows whose vector is null or holds null or non-finite entries are left out; entries
    beyond 2^46 count as 2^46, where doubles still are exact on the grid.
    """
    e = F.col("embedding").cast("array<double>")
    usable = F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    inside = F.transform(e, lambda c: F.greatest(F.lit(-_LARGEST), F.least(F.lit(_LARGEST), c)))
    x = F.transform(inside, lambda c: F.floor(c * SCALE) + OFFSET)
    return embeddings.filter(F.col("embedding").isNotNull() & usable).select(F.col("vec_id").cast("bigint"), x.alias("x"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _sums(grid: DataFrame) -> tuple[int, np.ndarray]:
    """Count and sum per dimension of the vectors of the commonest length (ties: the longest)."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            lengths = np.diff(batch.column(0).offsets.to_numpy())
            for dims in np.unique(lengths).tolist():
                held = sums.setdefault(dims, [0, np.zeros(dims, dtype=np.int64)])
                if dims:
                    held[1] += _matrix(batch.column(0).filter(pa.array(lengths == dims)), dims).sum(axis=0)
                held[0] += int((lengths == dims).sum())
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array([n for n, _ in sums.values()]), pa.array([s.tolist() for _, s in sums.values()], pa.list_(pa.int64()))],
                names=["dims", "n", "sums"],
            )

    parts = grid.select("x").mapInArrow(partial, "dims bigint, n bigint, sums array<bigint>")
    wide = F.col("value").cast("decimal(38,0)")
    # Entry 0 carries the count, so that one aggregation gives both.
    cells = parts.select("dims", F.posexplode(F.concat(F.array("n"), "sums")).alias("at", "value")).groupBy("dims", "at").agg(F.sum(wide).alias("value"))
    top = cells.filter("at = 0").orderBy(F.desc("value"), F.desc("dims")).select("dims").limit(1)
    rows = cells.join(F.broadcast(top), "dims").collect()
    found = {r["at"]: int(r["value"]) for r in rows}
    return found.pop(0, 0), np.array([found[i] for i in sorted(found)], dtype=object)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``n x - S``, exactly: as longs where they cannot overflow, else as Python integers."""
    reach = max((abs(int(s)) for s in sums), default=0) + n * (int(np.abs(x).max()) if x.size else 0)
    if reach < 1 << 62:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def _deviations(d: np.ndarray) -> pa.Array:
    """Exact sums of squares per row; null where they are beyond a long."""
    most = max(abs(int(d.max())), abs(int(d.min()))) if d.size else 0
    if d.dtype != object and most * most * d.shape[1] < 1 << 63:
        return pa.array((d * d).sum(axis=1))
    exact = [sum(int(v) ** 2 for v in row) for row in d]
    return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def _gram(rows: DataFrame, width: int, of_batch) -> np.ndarray:
    """Sum over all rows of ``y y'``, where ``of_batch`` gives the rows ``y`` of a batch."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            y = of_batch(batch)
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "row"])

    cells = (
        rows.mapInArrow(partial, "i bigint, row array<double>")
        .select("i", F.posexplode("row").alias("j", "v"))
        .filter("i <= j")
        .groupBy("i", "j")
        .agg(F.sum("v").alias("v"))
        .toPandas()
    )
    out = np.zeros((width, width))
    out[cells["i"], cells["j"]] = cells["v"]
    out[cells["j"], cells["i"]] = cells["v"]
    return out


def _leading(spark, matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``most`` leading eigenvalues beyond rounding, and their vectors, found by tasks."""
    norm = float(np.abs(matrix).sum(axis=1).max())
    if norm == 0:
        return np.zeros(0), np.zeros((len(matrix), 0))
    shared = spark.sparkContext.broadcast(matrix)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [spectrum.bracket(shared.value, k) for k in batch["id"]]
            yield pd.DataFrame({"k": batch["id"], "lo": [b[0] for b in found], "hi": [b[1] for b in found]})

    def bracketed(first: int, last: int) -> list[tuple[float, float]]:
        ks = spark.range(first, last + 1, 1, min(last - first + 1, COMPONENTS))
        return [(r.lo, r.hi) for r in ks.mapInPandas(find, "k bigint, lo double, hi double").orderBy("k").collect()]

    brackets = bracketed(1, min(most, len(matrix)))
    while len(brackets) < len(matrix):
        # The last cluster is refined whole, also where it reaches beyond the wanted components.
        n = spectrum.count_above(matrix, brackets[-1][0] - spectrum.CLUSTER * norm)
        if n <= len(brackets):
            break
        brackets += bracketed(len(brackets) + 1, n)

    groups = spectrum.clusters(brackets, norm)
    table = spark.createDataFrame(
        [(g[0] + 1, [brackets[i][0] for i in g], [brackets[i][1] for i in g]) for g in groups], "k bigint, lo array<double>, hi array<double>"
    ).repartition(len(groups), "k")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, lo, hi in batch.itertuples(index=False):
                values, vectors = spectrum.refine(shared.value, int(k), list(zip(lo, hi, strict=True)))
                yield pd.DataFrame({"k": int(k) + np.arange(len(values)), "value": values, "vector": vectors.T.tolist()})

    rows = table.mapInPandas(solve, "k bigint, value double, vector array<double>").orderBy("k").collect()
    shared.unpersist()
    real = [r for r in rows[:most] if r.value > 1e-12 * norm]
    return np.array([r.value for r in real]), np.array([r.vector for r in real]).reshape(len(real), len(matrix)).T


def fit(grid: DataFrame, components: int = COMPONENTS) -> Fit:
    """Mean and leading components of ``on_grid`` rows of the commonest length."""
    n, sums = _sums(grid)
    dims = len(sums)
    if dims > MAX_DIMS:
        raise ValueError(f"vectors have {dims} entries, more than {MAX_DIMS}")
    if not dims:
        return Fit(n, sums, np.zeros(0), np.zeros((0, 0)), 0.0)
    members = grid.filter(F.size("x") == dims).select("x")
    gram = _gram(members, dims, lambda b: _centred(_matrix(b.column(0), dims), n, sums).astype(np.float64) / n)
    covariance = gram / n
    values, vectors = _leading(grid.sparkSession, covariance, components)
    return Fit(n, sums, values, vectors, float(np.trace(covariance)))


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every usable row and component.

    Vectors that are null or hold null or non-finite entries are dropped.  One covariance
    needs one length: vectors of another length than most (ties: the longest) take no part.
    Components without variance beyond rounding (1e-12 of the norm) have no whitened values and
    are not returned, so a single vector, equal vectors, empty vectors and an empty table give
    no rows.  Repeated rows and null vec_ids stay as they are; other columns are ignored.
    ``deviation`` is exact, and null where a long cannot hold it.  Entries beyond 2^46 count as 2^46.
    """
    grid = on_grid(embeddings)
    model = fit(grid, components)
    k, dims = len(model.values), len(model.sums)
    members = grid.filter(F.size("x") == dims)
    shared = grid.sparkSession.sparkContext.broadcast((model.n, model.sums, model.vectors / np.sqrt(model.values)))

    def projected(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        n, sums, turn = shared.value
        d = _centred(_matrix(column, dims), n, sums)
        return d, d.astype(np.float64) / n @ turn

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), 1024):
                batch = whole.slice(start, 1024)
                d, w = projected(batch.column(1))
                row = pa.array(np.repeat(np.arange(len(batch)), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(row),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(batch))),
                        pa.array(np.full(len(row), model.n)),
                        _deviations(d).take(row),
                        pa.array(w.ravel()),
                        pa.array(np.tile(model.values / model.trace, len(batch))),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained"],
                )

    if not k:
        return members.select("vec_id").filter("false").selectExpr(
            "vec_id", *(f"CAST(NULL AS {t}) AS {c}" for c, t in (f.split(" ") for f in WHITENED.split(", ")[1:])), "CAST(NULL AS DOUBLE) AS identity_error"
        )
    # Whitened rows are projections of centred vectors, so their own mean is 0 up to rounding.
    covariance = _gram(members.select("x"), k, lambda b: projected(b.column(0))[1]) / model.n
    error = float(np.abs(covariance - np.eye(k)).max())
    return members.select("vec_id", "x").mapInArrow(run, WHITENED).withColumn("identity_error", F.lit(error))
