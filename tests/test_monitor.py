import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyflow.functions import guard_math as gm
from tallyflow.operators import monitor as mn
from tallyflow.operators.joinsize import JoinSizeQuery
from tallyflow.operators.levels import level_hits, next_exits, record_ends
from tallyflow.operators.sampling import level_changed
from tallyflow.operators.sketch import Projection
from tallyflow.session import shared_folder
from tallyflow.streaming.feeds import drain_batches, drain_to_table, stream_files
from tallyflow.streaming.levels import LevelFilter
from tallyflow.streaming.protocols import DriftPublisher, GuardedEstimate
from tallyflow.streaming.windows import window_counts
from tests.helpers import collect, frame, literal_sketch, random_updates

PROJ = Projection(3, 10, seed=2)
# One record per time, so that slices of one tick are single records.
ROWS = [(s, h, k, 1, i, i) for i, (s, h, k, *_) in enumerate(random_updates(150, seed=3))]


def flat(updates):
    return np.array(literal_sketch(PROJ, updates), dtype=float).ravel()


def test_drift_publish_per_record(spark):
    theta, sites = 0.5, 4
    expected, state = [], {}
    for sid, hid, key, upd, ts, _ in ROWS:
        total, drift, n = state.get((sid, hid), (np.zeros(30), np.zeros(30), 0))
        step = flat([(key, upd)])
        total, drift, n = total + step, drift + step, n + 1
        if drift @ drift >= theta**2 / sites * (total @ total):
            expected.append((sid, hid, ts, n, float(drift @ drift)))
            drift, n = np.zeros(30), 0
        state[sid, hid] = (total, drift, n)
    out = mn.drift_publish(frame(spark, ROWS), PROJ, theta, sites, every=1)
    assert collect(out, "sid", "hid", "slice", "updates", "drift2") == sorted(expected)


def test_published_total_is_the_stream(spark):
    out = mn.drift_publish(frame(spark, ROWS), PROJ, 0.0, 4, every=10)
    last = mn.published_estimate(out, PROJ).groupBy("sid").agg(F.max_by("estimate", "slice").alias("e")).collect()
    for row in last:
        x = flat([(r[2], r[3]) for r in ROWS if r[0] == row["sid"]]).reshape(3, 10)
        assert row["e"] == statistics.median((x * x).sum(axis=1))


@pytest.mark.parametrize("rule", ["any_site", "sum"])
def test_monitor_follows_its_rule(spark, rule):
    proj, beta, sites, every = Projection(3, 60, seed=2), 0.8, 4, 10
    query = JoinSizeQuery(1, beta=beta)
    got = mn.monitor(frame(spark, ROWS), query, proj, sites, every, rule).orderBy("slice").collect()
    anchor, drift = np.zeros((3, 60)), {}
    moves = 0
    for row in got:
        for r in ROWS:
            if r[0] == 1 and r[4] // every == row["slice"]:
                u = np.array(literal_sketch(proj, [(r[2], r[3])]), dtype=float)
                drift[r[1]] = drift.get(r[1], 0) + u
        est = float(np.median((anchor * anchor).sum(axis=1)))
        low, high = gm.bounds(est, beta, proj.epsilon)
        zeta = [gm.selfjoin(anchor + sites * drift.get(h, 0), anchor, low, high) for h in range(sites)]
        za = gm.selfjoin(anchor, anchor, low, high)
        fire = row["slice"] == got[0]["slice"] or (min(zeta) <= 0 if rule == "any_site" else sum(zeta) < 0.01 * sites * za)
        assert row["reanchored"] == fire
        assert row["zeta_min"] == pytest.approx(min(zeta))
        if fire:
            anchor, drift, moves = anchor + sum(drift.values()), {}, moves + 1
        assert row["round"] == moves
        assert row["estimate"] == float(np.median((anchor * anchor).sum(axis=1)))
    with pytest.raises(ValueError):
        mn.monitor(frame(spark, ROWS), query, proj, sites, every, "never")


def test_warm_up_records_set_the_first_anchor(spark):
    proj, beta, sites, every = Projection(3, 60, seed=2), 0.8, 4, 10
    query = JoinSizeQuery(1, beta=beta)
    warm, live = [r for r in ROWS if r[4] < 60], [r for r in ROWS if r[4] >= 60]
    got = mn.monitor(frame(spark, live), query, proj, sites, every, warm=frame(spark, warm)).orderBy("slice").collect()
    cells = lambda rows: np.array(literal_sketch(proj, [(r[2], r[3]) for r in rows if r[0] == 1]), dtype=float)
    anchor, drift, moves = cells(warm), {}, 0
    for row in got:
        for r in live:
            if r[0] == 1 and r[4] // every == row["slice"]:
                drift[r[1]] = drift.get(r[1], 0) + cells([r])
        low, high = gm.bounds(float(np.median((anchor * anchor).sum(axis=1))), beta, proj.epsilon)
        zeta = [gm.selfjoin(anchor + sites * drift.get(h, 0), anchor, low, high) for h in range(sites)]
        assert row["zeta_min"] == pytest.approx(min(zeta)) and row["reanchored"] == (min(zeta) <= 0)
        if row["reanchored"]:
            anchor, drift, moves = anchor + sum(drift.values()), {}, moves + 1
        assert row["round"] == moves
        assert row["estimate"] == float(np.median((anchor * anchor).sum(axis=1)))
    assert not got[0]["reanchored"]


def test_warm_up_records_count_as_published(spark):
    theta, sites = 0.5, 4
    warm, live = [r for r in ROWS if r[4] < 60], [r for r in ROWS if r[4] >= 60]
    expected, state = [], {}
    for sid, hid, key, upd, _, _ in warm:
        total, drift = state.get((sid, hid), (np.zeros(30), np.zeros(30)))
        state[sid, hid] = (total + flat([(key, upd)]), drift)
    for sid, hid, key, upd, ts, _ in live:
        total, drift = state.get((sid, hid), (np.zeros(30), np.zeros(30)))
        total, drift = total + flat([(key, upd)]), drift + flat([(key, upd)])
        if drift @ drift >= theta**2 / sites * (total @ total):
            expected.append((sid, hid, ts, float(drift @ drift)))
            drift = np.zeros(30)
        state[sid, hid] = (total, drift)
    out = mn.drift_publish(frame(spark, live), PROJ, theta, sites, 1, frame(spark, warm))
    assert collect(out, "sid", "hid", "slice", "drift2") == sorted(expected)
    last = mn.published_estimate(mn.drift_publish(frame(spark, live), PROJ, 0.0, 4, 10, frame(spark, warm)), PROJ, warm=frame(spark, warm))
    for row in last.groupBy("sid").agg(F.max_by("estimate", "slice").alias("e")).collect():
        x = flat([(r[2], r[3]) for r in ROWS if r[0] == row["sid"]]).reshape(3, 10)
        assert row["e"] == statistics.median((x * x).sum(axis=1))


def test_error_bound_must_exceed_sketch_error(spark):
    with pytest.raises(ValueError):
        mn.monitor(frame(spark, ROWS), JoinSizeQuery(1, beta=0.5), Projection(3, 10), 4, 40)


def test_short_spans_and_several_queries_in_one_pass(spark, monkeypatch):
    queries = [JoinSizeQuery(0, beta=0.8), JoinSizeQuery(1, beta=0.8)]
    args = (Projection(3, 60), 4, 25, "any_site")
    want = mn.monitor_all(frame(spark, ROWS), queries, *args).orderBy("query", "slice").collect()
    monkeypatch.setattr(mn, "FIRST_SPAN", 1)
    assert mn.monitor_all(frame(spark, ROWS), queries, *args).orderBy("query", "slice").collect() == want
    for q in queries:
        alone = mn.monitor(frame(spark, ROWS), q, *args).orderBy("slice").collect()
        assert [tuple(r)[1:] for r in want if r["query"] == str(q)] == [tuple(r) for r in alone]
    assert any(r["reanchored"] for r in want) and not all(r["reanchored"] for r in want)


def test_message_sizes(spark):
    from tallyflow.functions.scalars import publish_bytes

    df = spark.createDataFrame([(10,), (1000,)], "n bigint")
    assert [r[0] for r in df.select(publish_bytes(F.col("n"), 30)).collect()] == [80, 120]


def literal_levels(values, p, d):
    last, out = values[0], []
    for i, f in enumerate(values[1:], 1):
        if abs(f - last) > p * abs(last) + d:
            out.append(i)
            last = f
    return out


def test_level_hits_any_stretch():
    values = np.array([r[2] for r in random_updates(500, seed=8)], dtype=float)
    for step in (1, 3, 1000):
        assert level_hits(values, None, 0.3, 2.0, step)[0] == literal_levels(values, 0.3, 2.0)
    first, last = level_hits(values[:200], None, 0.3, 2.0)
    rest, _ = level_hits(values[200:], last, 0.3, 2.0)
    assert first + [200 + i for i in rest] == literal_levels(values, 0.3, 2.0)


def write_batches(spark, rows, parts):
    """One file per batch, in time order."""
    folder = shared_folder(spark)
    size = len(rows) // parts
    for i in range(parts):
        chunk = rows[i * size :] if i == parts - 1 else rows[i * size : (i + 1) * size]
        frame(spark, chunk).coalesce(1).write.mode("append").parquet(folder)
    return folder


def feed(spark, folder):
    return stream_files(spark, folder, frame(spark, []).schema, files_per_trigger=1)


def test_streaming_levels_equal_batch(spark, monkeypatch):
    """Over several micro-batches, each cut into several segments."""
    folder, out = write_batches(spark, ROWS, 3), shared_folder(spark)
    stream = feed(spark, folder)
    levels = LevelFilter(spark, out, stream.schema, "key", 0.2, 1.0)
    seen = []

    def handle(batch, batch_id):
        seen.append(batch_id)
        levels.handle(batch, batch_id)
        if batch_id == 1:
            levels.handle(batch, batch_id)  # a replayed batch changes nothing

    drain_batches(stream, handle, out)
    batch = level_changed(frame(spark, ROWS).select("sid", "ts", "seq", "key"), "key", 0.2, 1.0)
    assert seen == [0, 1, 2]
    assert collect(levels.changes(), "sid", "seq", "level") == collect(batch, "sid", "seq", "level")


def test_streaming_window_counts_equal_batch(spark):
    folder = write_batches(spark, ROWS, 3)
    got = collect(drain_to_table(window_counts(feed(spark, folder), 20, 10)), "window_end", "sid", "active")
    batch = window_counts(frame(spark, ROWS), 20, 10).where(F.col("window_end") <= ROWS[-1][4])
    assert got == collect(batch, "window_end", "sid", "active")


def test_streaming_publisher_per_batch_and_replay(spark):
    theta, sites, folder = 0.5, 4, shared_folder(spark)
    site = DriftPublisher(spark, folder, PROJ, theta, sites)
    batches = [ROWS[:40], ROWS[40:50], ROWS[50:110], ROWS[110:]]
    state, expected = {}, {}
    for i, rows in enumerate(batches):
        site.handle(frame(spark, rows), i)
        if i == 2:
            site.handle(frame(spark, rows), i)  # a replayed batch changes nothing
        for local in {(r[0], r[1]) for r in rows} | set(state):
            total, drift = state.get(local, (np.zeros(30), np.zeros(30)))
            step = flat([(r[2], r[3]) for r in rows if (r[0], r[1]) == local])
            total, drift = total + step, drift + step
            if drift @ drift and drift @ drift >= theta**2 / sites * (total @ total):
                expected[local[0]] = expected.get(local[0], 0) + drift
                drift = np.zeros(30)
            state[local] = (total, drift)
    got = dict(collect(site.estimate(), "sid", "estimate"))
    for sid, x in expected.items():
        x = x.reshape(3, 10)
        assert got[sid] == statistics.median((x * x).sum(axis=1))


@pytest.mark.parametrize("query", [JoinSizeQuery(1, beta=0.8), JoinSizeQuery(0, 1, beta=0.8)])
def test_streaming_monitor_equals_batch(spark, query):
    proj = Projection(3, 60, seed=2)
    folder = shared_folder(spark)
    guard = GuardedEstimate(spark, folder, query, proj, 4, "any_site")
    for i in range(4):
        rows = [r for r in ROWS if 40 * i <= r[4] < 40 * (i + 1)]
        guard.handle(frame(spark, rows), i)
    guard.handle(frame(spark, rows), 3)
    live = guard.rounds.all().orderBy("batch").collect()
    batch = mn.monitor(frame(spark, ROWS), query, proj, 4, 40, "any_site").orderBy("slice").collect()
    assert len(live) == len(batch)
    for a, b in zip(live, batch):
        assert (a["reanchored"], a["estimate"], a["updates"], a["bytes"]) == (b["reanchored"], b["estimate"], b["updates"], b["bytes"])
        if a["batch"]:
            assert a["zeta_min"] == pytest.approx(b["zeta_min"], abs=1e-6)
            assert a["zeta_sum"] == pytest.approx(b["zeta_sum"], abs=1e-6)


def test_monitor_runs_from_a_stream(spark):
    folder = write_batches(spark, ROWS, 2)
    guard = GuardedEstimate(spark, folder + "-state", JoinSizeQuery(1, beta=0.8), Projection(3, 60), 4)
    drain_batches(feed(spark, folder), guard.handle, folder + "-state")
    assert guard.rounds.all().count() == 2
