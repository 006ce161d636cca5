import math
import random

import numpy as np
from pyspark.sql import functions as F

from tallyflow.llm import topk
from tallyflow.llm.topk import LEVELS, ShardIndex, Work, top_k, top_of_shard


def literal(rows, k, every):
    vectors = {}
    for vec_id, e in rows:
        if vec_id is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            vectors[vec_id] = [math.floor(256 * x) for x in e]
    out = set()
    for q, a in vectors.items():
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), c) for c, b in vectors.items() if c != q and len(b) == len(a))
            out |= {(q, rank + 1, c, -s) for rank, (s, c) in enumerate(scores[:k])}
    return out


def got(df):
    return {(r.query_id, r.rank, r.vec_id, r.score) for r in df.collect()}


def test_ties_small_tables_and_rows_that_take_no_part(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)]) for i in range(200)]
    rows += [(200, None), (202, [1.0, None, 0.0, 0.0]), (204, [float("nan")] * 4), (206, [float("inf"), 0.0, 0.0, 0.0])]
    rows += [(300, [1.0, 2.0]), (301, [2.0, 2.0]), (None, [1.0] * 4), (400, [5.0] * 3), (500, [])]
    table = spark.createDataFrame([(e, v, 1, 2) for v, e in rows], "embedding array<double>, vec_id bigint, rank int, row int")
    assert got(top_k(table, F.col("vec_id") % 10 == 0)) == literal(rows, 5, 10)
    assert top_k(table.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert top_k(table, F.col("vec_id") < 0).count() == 0


def test_repeated_rows(spark):
    table = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (1, [0.5]), (1, [0.5])], "vec_id bigint, embedding array<float>")
    rows = top_k(table, F.col("vec_id") == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in rows) == [(0, 1, 1, 32768)] * 2 + [(0, 2, 1, 32768)] * 2


def test_a_query_stops_on_proof_only():
    rng = np.random.default_rng(2)
    vectors = rng.integers(-250, 250, (3000, 24)) * rng.integers(0, 2, (3000, 24))
    vectors[5] *= 4
    ids = rng.permutation(3000).astype(np.int64)
    queries = vectors[:40]
    tops = top_of_shard(ShardIndex.of(vectors), ids, queries, ids[:40], 5)
    for row, top in enumerate(tops):
        exact = vectors @ queries[row]
        exact[row] = -(2**62)
        order = np.lexsort((ids, -exact))[:5]
        assert top[:, 0].tolist() == order.tolist() and top[:, 1].tolist() == exact[order].tolist()


def test_segments_hold_every_posting_once():
    vectors = np.random.default_rng(3).integers(-9, 9, (50, 4))
    index = ShardIndex.of(vectors)
    seen = {}
    for level in range(LEVELS):
        for dimension in range(8):
            members, impacts = index.segment(level, dimension)
            for m, x in zip(members.tolist(), impacts.tolist(), strict=True):
                assert (m, dimension) not in seen
                assert index.step[dimension] * level <= x + 1e-9 and (x <= index.step[dimension] * (level + 1) + 1e-9)
                seen[m, dimension] = x + index.base[dimension]
    both = np.hstack([vectors, -vectors])
    assert seen == {(m, d): both[m, d] for m in range(50) for d in range(8)}


def test_fewer_postings_than_all_are_read():
    rng = np.random.default_rng(4)
    vectors = rng.integers(-250, 250, (2000, 16))
    vectors[:20] *= 3
    ids, queries = np.arange(2000), vectors[:40]
    alone, floored = Work(), Work()
    tops = top_of_shard(ShardIndex.of(vectors), ids, queries, ids[:40], 5, work=alone)
    floor = np.array([t[-1, 1] for t in tops], dtype=float)
    assert alone.read < alone.of
    # A shard without any good vector is given up earlier.
    far = rng.integers(-50, 50, (2000, 16))
    top_of_shard(ShardIndex.of(far), ids + 5000, queries, ids[:40], 5, floor, floored)
    assert floored.read < 0.8 * floored.of


def test_several_shards_blocks_and_lots(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 30)
    monkeypatch.setattr(topk, "BLOCK", 7)
    monkeypatch.setattr(topk, "LOT", 2)
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1.0, -0.25, 0.0, 0.5]) for _ in range(5)]) for i in range(300)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    out = top_k(table, F.col("vec_id") % 10 == 0)
    assert got(out) == literal(rows, 5, 10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Join" not in top_k(table, F.col("vec_id") % 10 == 0)._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
