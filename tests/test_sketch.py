import math
import statistics
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyflow.functions.mixing import uniform31, uniform31_array
from tallyflow.operators import sketch as sk
from tallyflow.operators import vectors
from tallyflow.operators.frequency import (
    frequency_vector,
    median,
    order_select,
)
from tallyflow.operators.sampling import spread_choice
from tallyflow.operators.segments import Segments
from tallyflow.plans.catalog import QUERIES
from tallyflow.sources.generators import trial_counts
from tests.helpers import cell, collect, frame, literal_sketch, random_updates

PROJ = sk.Projection(5, 23, seed=3)
ROWS = random_updates(200, seed=9)
SEG = Segments(("ts", "seq"), 13)


def dense(proj, cells):
    out = [[0] * proj.width for _ in range(proj.depth)]
    for r in cells.collect():
        out[r["d"]][r["b"]] = r["c"]
    return out


def test_sketch_is_the_literal_one(spark):
    rows = [r for r in ROWS if r[0] == 1]
    got = dense(PROJ, sk.sketch(frame(spark, rows), PROJ).drop("sid"))
    assert got == literal_sketch(PROJ, [(r[2], r[3]) for r in rows])


def test_large_and_negative_keys(spark):
    keys = [0, 1, 2**31 - 1, 2**31, 2**40 + 3, -1, -(2**33)]
    rows = [(0, 0, k, 1, i, i) for i, k in enumerate(keys)]
    got = dense(PROJ, sk.sketch(frame(spark, rows), PROJ).drop("sid"))
    assert got == literal_sketch(PROJ, [(k, 1) for k in keys])


def test_erase_undoes_insert(spark):
    keys = list(range(10, 1000, 17))
    rows = [(0, 0, k, u, i, i) for i, (k, u) in enumerate([(k, 1) for k in keys] + [(k, -1) for k in keys])]
    assert sk.sketch(frame(spark, rows), sk.Projection(5, 500)).where("c <> 0").count() == 0


def test_linearity(spark):
    a, b = frame(spark, ROWS[:120]), frame(spark, ROWS[120:])
    whole = sk.sketch(frame(spark, ROWS), PROJ)
    parts = sk.add(sk.sketch(a, PROJ), sk.sketch(b, PROJ))
    assert sk.differing_cells(whole, parts).first()[0] == 0
    assert sk.subtract(whole, parts).where("c <> 0").count() == 0
    four_minus_three = sk.subtract(sk.scale(whole, 4), sk.scale(whole, 3))
    assert sk.differing_cells(whole, four_minus_three).first()[0] == 0


def test_single_key_in_two_sketches(spark):
    one = frame(spark, [(0, 0, 243521, 1, 1, 1)])
    proj = sk.Projection(11, 500)
    s = sk.sketch(one, proj, [])
    assert sk.join_estimate(s, s, proj).first()[0] == 1.0


def test_disjoint_sketches_have_zero_rows(spark):
    proj = sk.Projection(3, 1000)
    a = sk.sketch(frame(spark, [(0, 0, 1, 1, 1, 1)]), proj, [])
    b = sk.sketch(frame(spark, [(0, 0, 2, 1, 1, 1)]), proj, [])
    assert collect(sk.row_dots(a, b, proj), "d", "dot") == [(d, 0.0) for d in range(3)]


def test_signs_are_balanced():
    for seeds in sk.Projection(5, 100).seeds():
        plus = sum(cell(seeds, 100, k)[1] == 1 for k in range(1000))
        assert 420 <= plus <= 580


def test_running_estimate_equals_from_scratch(spark):
    rows = [(i % 2, 0, i * i + 13 * i + 7, 1, i // 4, i) for i in range(60)]
    seg = Segments(("ts", "seq"), 6)
    run = {r["seq"]: r["estimate"] for r in sk.join_estimate_running(frame(spark, rows), 0, 1, PROJ, seg).collect()}
    own = {r["seq"]: r["estimate"] for r in sk.selfjoin_estimate_running(frame(spark, rows), PROJ, seg).collect()}
    for n in (1, 17, 40, 60):
        s = [literal_sketch(PROJ, [(r[2], r[3]) for r in rows[:n] if r[0] == sid]) for sid in (0, 1)]
        dots = [sum(x * y for x, y in zip(a, b)) for a, b in zip(*s)]
        assert run[n - 1] == statistics.median(dots)
        mine = s[rows[n - 1][0]]
        assert own[n - 1] == statistics.median(sum(x * x for x in row) for row in mine)


def test_running_with_deletions_and_crowded_times(spark):
    run = sk.selfjoin_estimate_running(frame(spark, ROWS), PROJ, SEG)
    last = {r["sid"]: r["e"] for r in run.groupBy("sid").agg(F.max_by("estimate", F.struct("ts", "seq")).alias("e")).collect()}
    batch = {r["sid"]: r["estimate"] for r in sk.selfjoin_estimate(sk.sketch(frame(spark, ROWS), PROJ), PROJ).collect()}
    assert last == batch


def test_order_statistics_of_groups(spark):
    values = [3.0, None, 1.0, 2.0, 2.0, None, 2.0, 9.5, -4.0] * 5
    df = spark.createDataFrame([(i % 2, v) for i, v in enumerate(values)] + [(2, None)], "g int, v double")
    medians = {r["g"]: r["median"] for r in median(df, "v", ["g"]).collect()}
    some = df.where("g < 2")
    for g in (0, 1):
        mine = sorted(v for i, v in enumerate(values) if i % 2 == g and v is not None)
        assert medians[g] == statistics.median(mine)
        for k in (0, 1, 8):
            assert {r["g"]: r["v"] for r in order_select(some, "v", k, ["g"]).collect()}[g] == mine[k]
    assert medians[2] is None
    with pytest.raises(Exception, match="no more than 0"):
        order_select(df, "v", 0, ["g"]).collect()
    nulls = spark.createDataFrame([(1,), (2,), (3,), (None,), (None,)], "v bigint")
    assert median(nulls, "v").first()[0] == 2.0
    assert [order_select(nulls, "v", k).first()[0] for k in (0, 1, 2)] == [1, 2, 3]


def test_order_select_fixture(spark):
    df = spark.createDataFrame([(3,), (1,), (2,)], "v bigint")
    assert [order_select(df, "v", k).first()[0] for k in (1, 0, 2)] == [2, 1, 3]
    with pytest.raises(Exception, match="no more than 3"):
        order_select(df, "v", 3).collect()
    pairs = spark.createDataFrame([(5.0,), (5.0,), (1.0,), (1.0,)], "v double")
    assert median(pairs, "v").first()[0] == 3.0


def test_incremental_dot_fixture(spark):
    x = spark.createDataFrame([(i, float(i)) for i in range(1000)], "i int, v double")
    y = spark.createDataFrame([(i, i**0.5) for i in range(1000)], "i int, v double")
    delta = spark.createDataFrame([(2, 2.0, 0.0), (114, 114.0, 1.0), (256, 256.0, -10.0)], "i int, old double, new double")
    start = vectors.dot(x, y).first()[0]
    moved = vectors.dot_change(delta, y).first()[0]
    scratch = vectors.dot(vectors.apply_delta(x, delta), y).first()[0]
    assert abs(start + moved - scratch) < 1e-6
    n0 = vectors.dot(x, x).first()[0]
    new = vectors.apply_delta(x, delta)
    assert abs(n0 + vectors.square_change(delta).first()[0] - vectors.dot(new, new).first()[0]) < 1e-6


def test_spread_choice_is_the_recurrence(spark):
    for total in (1, 2, 7, 31, 59):
        for n in (1, 2, 3, 6, 30, 58, 70):
            m, want, p = min(n, total), [], 0
            for j in range(m):
                want.append(p)
                if j < m - 1:
                    p += (total - 1 - p) // (m - 1 - j)
            got = spark.range(total).where(spread_choice(F.col("id"), n, total))
            if (total, n) in {(7, 3), (31, 6), (59, 30), (59, 58), (2, 1), (31, 70)}:
                assert collect(got, "id") == [(w,) for w in want]
    with pytest.raises(ValueError):
        spread_choice(F.col("id"), 3, 0)


def test_sketch_udaf_is_the_sketch(spark):
    flat = frame(spark, ROWS).agg(sk.agms_udaf(PROJ)("key", "upd").alias("v")).first()["v"]
    assert list(flat) == [c for row in literal_sketch(PROJ, [(r[2], r[3]) for r in ROWS]) for c in row]


def test_point_estimate_of_a_lonely_key(spark):
    s = sk.sketch(frame(spark, [(0, 0, 77, 4, 1, 1)]), PROJ)
    keys = spark.createDataFrame([(0, 77), (0, 78)], "sid int, key bigint")
    got = dict(collect(sk.point_estimate(s, keys, PROJ), "key", "estimate"))
    assert got[77] == 4.0


def test_frequency_vector_adds_signs(spark):
    rows = [(0, 0, 1, 2, 1, 1), (0, 0, 1, -2, 2, 2), (0, 0, 3, 1, 3, 3)]
    assert collect(frequency_vector(frame(spark, rows)), "key", "cnt") == [(1, 0), (3, 1)]


def test_udaf_knows_both_hash_families(spark):
    for family in sk.FAMILIES:
        proj = sk.Projection(3, 11, seed=2, family=family)
        flat = frame(spark, ROWS).agg(sk.agms_udaf(proj)("key", "upd").alias("v")).first()["v"]
        cells = dense(proj, sk.sketch(frame(spark, ROWS), proj, []))
        assert list(flat) == [c for row in cells for c in row]
    assert not proj.compatible(sk.Projection(3, 11, seed=2))
    with pytest.raises(ValueError):
        sk.Projection(3, 11, family="none")


def test_array_hash_is_the_column_hash(spark):
    ids = [0, 1, 99, 2**31 - 1, 2**31, 2**40 + 3, 2**62 + 5, -1, -(2**33)]
    want = spark.createDataFrame([(i, v) for i, v in enumerate(ids)], "i int, v bigint").select("i", uniform31(F.col("v"), 11, "key"))
    assert [v for _, v in sorted(want.collect())] == uniform31_array(np.array(ids, dtype=np.int64), 11, "key").tolist()


def test_trial_counts_are_those_of_all_records(spark):
    ids, ranges, shares, trials = [*range(-45, 250), 7, 7, 10**8 + 1], (6, 40), (1, 5, 10), 10
    want = Counter()
    for e in ids:
        for m in ranges:
            for share in shares:
                for i in range(share):
                    trial = int(math.fmod(e + i * (trials // share), trials))
                    name = np.array([((e * 1000003 + m) * 101 + share) * trials + i])
                    want[m, share, trial, int(uniform31_array(name, 3, "key")[0] * m >> 31) + 1] += 1
    df = spark.createDataFrame([(e,) for e in [*ids, None]], "id bigint")
    for block in (50, 4_000_000):
        got = Counter()
        for r in trial_counts(df, ranges, shares, trials, 3, block).collect():
            for key, n in zip(r["keys"], r["counts"], strict=True):
                got[r["max_key"], r["share"], r["trial"], key] += n
        assert got == want


def test_trials_pass_on_counts_not_records(spark, data):
    # 60,000 records in 3 streams of 5 keys each: a block passes on 15 counts at most.
    parts = trial_counts(spark.range(20_000), (5,), (3,), 3, 1).agg(F.count(F.lit(1)), F.sum(F.size("keys"))).first()
    blocks = spark.sparkContext.defaultParallelism
    assert parts[0] <= blocks * 3 and parts[1] <= blocks * 3 * 5
    plan = QUERIES["accuracy_sweep"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


def test_estimates_under_many_projections_are_the_literal_ones(spark):
    projections = [sk.Projection(d, w, seed=s, family=f) for d, w, s, f in
                   [(1, 7, 1, "xor"), (3, 7, 1, "xor"), (5, 19, 1, "xor"), (4, 19, 2, "xor"), (3, 7, 1, "sum")]]
    parts = [("a", [1, 4, 900], [3, 1, 2]), ("b", [0], [5]), ("a", [4, 17], [6, 2]), ("a", [], [])]
    groups = {"a": {1: 3, 4: 7, 900: 2, 17: 2}, "b": {0: 5}}
    df = spark.createDataFrame(parts, "g string, keys array<int>, counts array<int>")
    got = sk.selfjoin_estimates(df, projections, ["g"]).collect()
    want = []
    for g, counts in groups.items():
        for p in projections:
            rows = [(0, 0, k, n, i, i) for i, (k, n) in enumerate(counts.items())]
            cells = dense(p, sk.sketch(frame(spark, rows), p).drop("sid"))
            estimate = statistics.median(sum(c * c for c in row) for row in cells)
            want.append((g, sum(counts.values()), sum(n * n for n in counts.values()), p.depth, p.width, estimate))
    assert sorted(tuple(r) for r in got) == sorted(want)
