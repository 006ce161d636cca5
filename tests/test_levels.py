"""Levels of long series in segments, against running through them."""

import numpy as np
import pytest

from tallyflow.operators.levels import border_runs, level_hits, next_exits, record_ends
from tallyflow.operators.sampling import level_changed
from tallyflow.operators.segments import Segments


def series(kind, n, seed):
    rng = np.random.default_rng(seed)
    kinds = {
        "noise": rng.integers(-20, 20, n),
        "walk": np.cumsum(rng.normal(size=n)),
        "rising": np.arange(n) * 0.3,
        "still": np.zeros(n),
        "spikes": np.where(rng.random(n) < 0.01, 50.0, 1.0),
    }
    return kinds[kind].astype(float)


KINDS = ["noise", "walk", "rising", "still", "spikes"]


@pytest.mark.parametrize("kind", KINDS)
def test_next_exits_and_ends(kind):
    for n in (1, 2, 3, 7, 64, 333):
        values = series(kind, n, n)
        for p, d in ((0.1, 1.0), (0.0, 0.0), (0.5, 3.0)):
            expected = [next((j for j in range(i + 1, n) if abs(values[j] - v) > p * abs(v) + d), n) for i, v in enumerate(values)]
            assert next_exits(values, p, d).tolist() == expected
            for place, end in zip(*record_ends(values, p, d), strict=True):
                assert level_hits(values[place + 1 :], values[place], p, d)[1] == end


def table(spark, groups):
    rows = [(sid, i, i, float(v)) for sid, values in groups.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "sid int, ts bigint, seq bigint, f double").repartition(5)


def expected(groups, p, d, first):
    return sorted((sid, i) for sid, values in groups.items() for i in level_hits(values, first, p, d)[0])


@pytest.mark.parametrize("first", [None, 3.0])
@pytest.mark.parametrize("pieces", [1, 3, 16])
def test_any_number_of_segments(spark, first, pieces):
    groups = {i: series(k, 300 - 40 * i, i) for i, k in enumerate(KINDS)} | {7: np.array([5.0])}
    df = table(spark, groups)
    for p, d in ((0.1, 2.0), (0.3, 5.0)):
        out = level_changed(df, "f", p, d, first=first, segments=Segments(("sid", "ts", "seq"), pieces)).collect()
        assert sorted((r.sid, r.ts) for r in out) == expected(groups, p, d, first)
        assert all(r.level == groups[r.sid][r.ts] for r in out)


def test_without_groups_and_with_missing_values(spark):
    values = series("walk", 400, 9)
    rows = [(None if i % 50 == 0 else i % 3, i, i, None if i % 7 == 0 else float("nan") if i % 11 == 0 else float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "sid int, ts bigint, seq bigint, f double")
    kept = [(s, t, v) for s, t, _, v in rows if v is not None and v == v]
    one = level_changed(df, "f", 0.1, 1.0, by=(), segments=Segments(("ts", "seq"), 9)).collect()
    hits = level_hits(np.array([v for *_, v in kept]), None, 0.1, 1.0)[0]
    assert sorted(r.ts for r in one) == [kept[i][1] for i in hits]
    by = level_changed(df, "f", 0.1, 1.0, segments=Segments(("sid", "ts", "seq"), 9)).collect()
    want = []
    for sid in {s for s, *_ in kept}:
        mine = [(t, v) for s, t, v in kept if s == sid]
        want += [(sid is None, sid or 0, mine[i][0]) for i in level_hits(np.array([v for _, v in mine]), None, 0.1, 1.0)[0]]
    assert sorted((r.sid is None, r.sid or 0, r.ts) for r in by) == sorted(want)
    assert level_changed(df.limit(0), "f", 0.1).count() == 0


def test_only_groups_across_borders_are_looked_through(spark):
    df = table(spark, {i: series("walk", 20, i) for i in range(40)})
    tagged = Segments(("sid", "ts", "seq"), 5).tag(df.withColumnRenamed("f", "level"))
    runs = border_runs(tagged, ["sid"], ["ts", "seq"], 0.1, 1.0).collect()
    assert len({r.sid for r in runs}) <= 4 and len(runs) <= 8
