from collections import defaultdict

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyflow.operators import sketch as sk
from tallyflow.operators.joinsize import join_running, join_size, selfjoin_running, selfjoin_size
from tallyflow.operators.segments import Segments, positions, previous_values, running_sums
from tallyflow.operators.sketch import Projection
from tests.helpers import collect, frame, random_updates

ROWS = random_updates()
# From one segment to more segments than rows.
CUTS = {n: Segments(("ts", "seq"), n) for n in (1, 2, 9, 60, 700)}


@pytest.fixture(params=CUTS, scope="module")
def seg(request):
    return CUTS[request.param]


def test_positions(spark, seg):
    out = collect(positions(frame(spark, ROWS), segments=seg), "seq", "pos")
    assert out == [(i, i) for i in range(len(ROWS))]


def test_running_sums_per_group(spark, seg):
    out = running_sums(frame(spark, ROWS), {"s": F.col("upd")}, ["key"], seg)
    state, expected = defaultdict(int), []
    for _, _, key, upd, _, seq in ROWS:
        state[key] += upd
        expected.append((seq, state[key]))
    assert collect(out, "seq", "s") == expected


def test_previous_values(spark, seg):
    out = previous_values(frame(spark, ROWS), {"key": "before"}, ["hid"], seg)
    last, expected = {}, []
    for _, hid, key, _, _, seq in ROWS:
        expected.append((seq, last.get(hid)))
        last[hid] = key
    assert collect(out, "seq", "before") == expected


def test_selfjoin_running(spark, seg):
    out = collect(selfjoin_running(frame(spark, ROWS), seg), "seq", "estimate")
    state, est, expected = defaultdict(int), defaultdict(int), []
    for sid, _, key, upd, _, seq in ROWS:
        x = state[sid, key]
        est[sid] += (2 * x + upd) * upd
        state[sid, key] += upd
        expected.append((seq, float(est[sid])))
    assert out == expected


def test_join_running(spark, seg):
    out = collect(join_running(frame(spark, ROWS), 0, 2, seg), "seq", "estimate")
    state, est, expected = defaultdict(int), 0, []
    for sid, _, key, upd, _, seq in ROWS:
        if sid not in (0, 2):
            continue
        est += upd * state[2 - sid, key]
        state[sid, key] += upd
        expected.append((seq, float(est)))
    assert out == expected


def _sizes(df, seg):
    return [r["count"] for r in seg.tag(df).groupBy(*seg.columns).count().collect()]


def test_an_outlier_and_millisecond_times_leave_even_segments(spark):
    ids = spark.range(2_000_000)
    ts = F.when(F.col("id") == 0, 0).otherwise(F.lit(1_700_000_000_000) + F.col("id") * 5)
    df = ids.select(ts.alias("ts"), F.col("id").alias("seq"))
    seg = Segments.fit(df, target_rows=50_000, least=1)
    sizes = _sizes(df, seg)
    assert seg.pieces == 40 and len(sizes) <= 80 and max(sizes) <= 200_000


@pytest.mark.parametrize("kind", ["one time", "one order", "scattered ids", "floats"])
def test_crowds_are_cut_like_any_other_rows(spark, kind):
    i, n = F.col("id"), 40_000
    order = {
        "one time": [F.when(i % 3 == 0, 7).otherwise(i), i],
        "one order": [F.when(i % 3 == 0, 7).otherwise(i), F.when(i % 3 == 0, 7).otherwise(i)],
        "scattered ids": [F.lit(100), (i * 7919) % 10007 * F.lit(10**12)],
        "floats": [F.exp(F.sqrt(i.cast("double"))), i],
    }[kind]
    df = spark.range(n).select(order[0].alias("ts"), order[1].alias("seq"))
    seg = Segments.fit(df, target_rows=2_000, least=1)
    assert seg.pieces == 20 and max(_sizes(df, seg)) <= 8_000
    ranked = positions(df, segments=seg)
    want = df.withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("ts", "seq")) - 1)
    assert ranked.exceptAll(want).count() == 0 and want.exceptAll(ranked).count() == 0


@pytest.mark.parametrize("big", [4_000_000_000, 10**11])
def test_running_values_beyond_64_bits_equal_the_batch(spark, big):
    rows = [(0, 0, 1, big, 1, 0), (1, 0, 1, big, 2, 1), (0, 0, 1, 1, 3, 2), (0, 0, 2, big, 4, 3)]
    df = frame(spark, rows)
    last = {r["sid"]: r["e"] for r in selfjoin_running(df).groupBy("sid").agg(F.max_by("estimate", "seq").alias("e")).collect()}
    assert last == {r["sid"]: r["selfjoin"] for r in selfjoin_size(df).collect()}
    both = join_running(df, 0, 1).agg(F.max_by("estimate", "seq")).first()[0]
    assert both == join_size(df, 0, 1).first()["join_size"] == float(big * (big + 1))
    proj = Projection(depth=3, width=5)
    lanes = sk.selfjoin_estimate_running(df, proj).groupBy("sid").agg(F.max_by("estimate", "seq").alias("e")).collect()
    batch = sk.selfjoin_estimate(sk.sketch(df, proj), proj).collect()
    assert {r["sid"]: r["e"] for r in lanes} == {r["sid"]: r["estimate"] for r in batch}
    pair = sk.join_estimate_running(df, 0, 1, proj).agg(F.max_by("estimate", "seq")).first()[0]
    a, b = (sk.sketch(df.where(F.col("sid") == s), proj, []) for s in (0, 1))
    assert pair == sk.join_estimate(a, b, proj).first()["estimate"]


def test_every_update_has_its_row(spark):
    df = frame(spark, [(0, 0, 1, 1, 5, 0), (0, 0, 2, 1, 5, 0), (0, 0, 1, 1, 5, 0)])
    assert sk.selfjoin_estimate_running(df, Projection(depth=3, width=5)).count() == 3
    assert selfjoin_running(df).count() == 3


def test_sums_beyond_64_bits_do_not_fail(spark):
    big = 4_000_000_000
    rows = [(0, 0, 1, big, 1, 0), (0, 0, 1, 1, 2, 1), (0, 0, 2, big, 3, 2)]
    assert selfjoin_size(frame(spark, rows)).first()["selfjoin"] == float((big + 1) ** 2 + big**2)
