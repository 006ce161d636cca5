"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Vectors are turned into integers and dealt to shards.  A shard's index holds, for each
dimension (as it is, for positive weights, and negated, for negative ones), a list of
postings: vector and impact.  Impacts are quantised to ``LEVELS`` equal steps, and the postings
of one dimension and step are a segment.  A block of queries reads the segments by
descending step; a query reads only those of dimensions in which it has a weight.  After each step
a vector's score so far is a lower bound, and the weights not yet met at it, times the
next step's upper edge, bound what may come.  A query stops on proof: when no more than a
few vectors can still reach the k-th best lower bound.  These are rescored exactly.  A task goes
through several shards and hands the k-th best score of one to the next.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyflow.llm.scratch import Scratch

#: Vectors per shard, queries per block, steps of quantised impact.
SHARD = 4096
BLOCK = 512
LEVELS = 16
SCALE = 256
#: Shards that a task goes through for one block of queries, and queries scored side by side.
LOT = 8
ABREAST = 128
#: Steps after which a proof is tried; before the first of them too little has been met.
CHECKED = (10, 7, 5, 4, 3, 2, 1, 0)

PACKED = "dim int, part bigint, rows binary, ids binary, vectors binary"


def integer_vectors(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, dim, vector`` with components floor(scale * x); only whole, finite vectors with an id."""
    vector = F.col("embedding")
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return table.filter(F.col("vec_id").isNotNull() & vector.isNotNull() & whole).select(
        F.col("vec_id").cast("bigint"),
        F.size(vector).alias("dim"),
        F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("vector"),
    )


def _pack(numbered: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Vectors of one dimension count in parts of about ``size``, one row per part; and the number of parts.

    Parts are dealt by row number, so repeated rows and ids do not crowd one of them.
    """
    parts = max(1, -(-numbered.count() // size))

    def pack(table: pa.Table) -> pa.Table:
        def raw(column: str) -> bytes:
            return table.column(column).combine_chunks().to_numpy(zero_copy_only=False).tobytes()

        vectors = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        one = [table.column("dim")[0].as_py(), table.column("part")[0].as_py()]
        values = [*one, raw("row"), raw("vec_id"), vectors.astype(np.int64).tobytes()]
        return pa.table([[v] for v in values], schema=pa.schema(
            [("dim", pa.int32()), ("part", pa.int64()), ("rows", pa.binary()), ("ids", pa.binary()), ("vectors", pa.binary())]
        ))

    dealt = numbered.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)))
    return dealt.groupBy("dim", "part").applyInArrow(pack, PACKED), parts


@dataclass
class ShardIndex:
    """Postings of a shard in segments, one after the other by falling level and then by dimension."""

    vectors: np.ndarray
    #: Vector and impact (from 0 up) of every posting, and where segment (level, dimension) starts.
    members: np.ndarray
    impacts: np.ndarray
    starts: np.ndarray
    #: Least value and step of each dimension.
    base: np.ndarray
    step: np.ndarray
    levels: np.ndarray
    bounds: dict[int, np.ndarray]

    @classmethod
    def of(cls, vectors: np.ndarray) -> ShardIndex:
        both = np.hstack([vectors, -vectors]).astype(np.float64)
        base = both.min(axis=0)
        impacts = both - base
        step = np.maximum(impacts.max(axis=0), 1) / LEVELS
        levels = np.minimum((impacts / step).astype(np.int64), LEVELS - 1)
        wide = both.shape[1]
        segment = (LEVELS - 1 - levels) * wide + np.arange(wide)
        order = np.argsort(segment.ravel(), kind="stable")
        starts = np.searchsorted(segment.ravel()[order], np.arange(LEVELS * wide + 1))
        return cls(vectors, order // wide, impacts.ravel()[order].astype(np.float32), starts, base, step, levels.astype(np.int8), {})

    def unmet(self, level: int) -> np.ndarray:
        """Upper bounds of the impacts below a level, 0 for those met already."""
        if level not in self.bounds:
            self.bounds[level] = np.where(self.levels < level, self.step * level, 0.0).astype(np.float32)
        return self.bounds[level]

    def segment(self, level: int, dimension: int) -> tuple[np.ndarray, np.ndarray]:
        """Vectors, each once, and impacts of one segment."""
        at = (LEVELS - 1 - level) * len(self.base) + dimension
        cut = slice(self.starts[at], self.starts[at + 1])
        return self.members[cut], self.impacts[cut]


@dataclass
class Work:
    """Postings read by all queries, of all that their weights ask for."""

    read: int = 0
    of: int = 0


def top_of_shard(
    index: ShardIndex, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray | None = None, work: Work | None = None
) -> list[np.ndarray]:
    """For each query the positions and scores of its k best vectors in the shard, by score and then id.

    ``own`` is left out.  Vectors that cannot reach the query's ``floor``, a score that k others have, may be missing.
    """
    out: list[np.ndarray] = []
    for at in range(0, len(queries), ABREAST):
        cut = slice(at, at + ABREAST)
        out += _few_queries(index, ids, queries[cut], own[cut], k, None if floor is None else floor[cut], work)
    return out


def _few_queries(
    index: ShardIndex, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray | None, work: Work | None
) -> list[np.ndarray]:
    """``top_of_shard`` for so few queries that a vector's scores stay together in the cache."""
    weights = np.hstack([np.maximum(queries, 0), np.maximum(-queries, 0)]).astype(np.float64)
    few = max(4 * k, len(ids) // 100)
    # Impacts count from the least value, so a score is this much more.
    offset = weights @ index.base
    known = np.full(len(queries), -np.inf) if floor is None else floor - offset
    #: Bounds are sums in single precision; this covers their rounding.
    slack = 1e-5 * (1 + np.abs(weights).sum(axis=1) * (index.step.max(initial=0) * LEVELS + np.abs(index.base).max(initial=0)))
    scaled = np.ascontiguousarray(weights.T, dtype=np.float32)
    score = np.zeros((len(ids), len(queries)), dtype=np.float32)
    foreign = ids[:, None] != own[None, :]
    possible: list[np.ndarray] = [np.zeros(0, np.int64)] * len(queries)
    active = np.arange(len(queries))
    for level in range(LEVELS - 1, -1, -1):
        for dimension in range(len(index.base)):
            members, impacts = index.segment(level, dimension)
            weight = scaled[dimension]
            asking = int(np.count_nonzero(weight))
            if not len(members) or not asking:
                continue
            score[members] += impacts[:, None] * weight
            if work is not None:
                work.read += asking * len(members)
        if level not in CHECKED:
            continue
        upper = score + index.unmet(level) @ scaled
        lower = np.where(foreign, score, -np.inf)
        best = np.partition(lower, -k, axis=0)[-k] if len(ids) > k else np.full(len(active), -np.inf)
        reach = (upper >= (np.maximum(best, known[active]) - slack[active])[None, :]) & foreign
        done = (reach.sum(axis=0) <= few) if level else np.ones(len(active), dtype=bool)
        for column in np.flatnonzero(done):
            possible[active[column]] = np.flatnonzero(reach[:, column])
        # A query that has its proof reads no further segment.
        if done.all():
            break
        if done.any():
            active = active[~done]
            scaled, score, foreign = (np.ascontiguousarray(x[:, ~done]) for x in (scaled, score, foreign))
    if work is not None:
        work.of += int((weights > 0).sum()) * len(ids)
    out = []
    for query, members in zip(queries, possible, strict=True):
        exact = index.vectors[members] @ query
        order = np.lexsort((ids[members], -exact))[:k]
        out.append(np.column_stack([members[order], exact[order]]))
    return out


def top_k(table: DataFrame, is_query: Column, k: int = 5, scale: int = SCALE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best other vectors of every query row, ties to the smaller vec_id.

    A vector that is null or holds a null or non-finite component takes no part, nor does
    one without vec_id; vectors are compared with those of the same length.  Rows with
    the query's own vec_id are not its candidates.  Repeated rows are candidates (and
    queries) each.  Scores must fit in 64 bits: components beyond 2^62 / scale become
    that large and their scores are not exact.  ``is_query`` is a condition on vec_id;
    other columns are ignored.
    """
    scratch = Scratch(table.sparkSession)
    vectors = scratch.keep(integer_vectors(table, scale), "vectors")
    # Row numbers follow fixed files.
    numbered = vectors.withColumn("row", F.monotonically_increasing_id())
    index, shards = _pack(numbered, SHARD)
    blocks, n_blocks = _pack(numbered.filter(F.coalesce(is_query, F.lit(False))), BLOCK)
    index, blocks = scratch.keep(index, "index"), scratch.keep(blocks, "blocks")
    # Every block meets every shard: a stated query set against all rows.  Both sides name the
    # (block, lot of shards) they go to, so there is no join and no key that many of them share.
    lots = -(-shards // LOT)
    packed = ["rows", "ids", "vectors"]
    left = index.select(
        "dim", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_blocks - 1).cast("bigint"))).alias("block"), (F.col("part") % lots).alias("lot"), F.lit(False).alias("asks"), *packed
    )
    right = blocks.select(
        "dim", F.col("part").alias("block"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(lots - 1).cast("bigint"))).alias("lot"), F.lit(True).alias("asks"), *packed
    )

    def score(table: pa.Table) -> pa.Table:
        dim, asks = table.column("dim")[0].as_py(), table.column("asks").to_pylist()

        def part(row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            rows, ids, vectors = (np.frombuffer(table.column(c)[row].as_py(), np.int64) for c in packed)
            return rows, ids, vectors.reshape(len(ids), dim)

        found: list[list[np.ndarray]] = []
        q_rows = q_ids = np.zeros(0, np.int64)
        if True in asks:
            q_rows, q_ids, queries = part(asks.index(True))
            found = [[] for _ in q_ids]
            floor = np.full(len(q_ids), -np.inf)
            for row in np.flatnonzero(~np.array(asks)):
                _, ids, vectors = part(int(row))
                for q, top in enumerate(top_of_shard(ShardIndex.of(vectors), ids, queries, q_ids, k, floor)):
                    found[q].append(np.column_stack([ids[top[:, 0]], top[:, 1]]))
                    kept = np.concatenate(found[q])
                    found[q] = [kept[np.lexsort((kept[:, 0], -kept[:, 1]))[:k]]]
                    if len(found[q][0]) == k:
                        floor[q] = found[q][0][-1, 1]
        tops = [np.concatenate(x) if x else np.zeros((0, 2), np.int64) for x in found]
        count = [len(t) for t in tops]
        every = np.concatenate(tops) if tops else np.zeros((0, 2), np.int64)
        return pa.table(
            {"q_row": np.repeat(q_rows, count), "query_id": np.repeat(q_ids, count), "vec_id": every[:, 0], "score": every[:, 1]}
        )

    found = left.unionByName(right).groupBy("dim", "block", "lot").applyInArrow(
        score, "q_row bigint, query_id bigint, vec_id bigint, score bigint"
    )
    order = Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
