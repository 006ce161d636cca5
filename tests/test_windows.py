from collections import deque

import pytest

from tallyflow.operators import transforms as tr
from tallyflow.operators import windows as wn
from tests.helpers import collect, frame, random_updates

ROWS = random_updates(300, seed=4)


def literal_time_window(rows, length, flush):
    """Arrivals in order; before each, all expiries that are due strictly earlier."""
    out, held = [], deque()
    for r in rows:
        while held and held[0][4] + length < r[4]:
            e = held.popleft()
            out.append((*e[:3], -e[3], e[4] + length, e[5], 1))
        out.append((*r, 0))
        held.append(r)
    if flush:
        for e in held:
            out.append((*e[:3], -e[3], e[4] + length, e[5], 1))
    return out


@pytest.mark.parametrize("length", [4, 17])
@pytest.mark.parametrize("flush", [False, True])
def test_time_window(spark, length, flush):
    out = wn.time_window(frame(spark, ROWS), length, flush).orderBy("ts", "kind", "seq").collect()
    got = [(r["sid"], r["hid"], r["key"], r["upd"], r["ts"], r["seq"], r["kind"]) for r in out]
    assert got == literal_time_window(ROWS, length, flush)


def literal_count_window(rows, size, flush):
    out, held, last = [], deque(), None
    for r in rows:
        if len(held) == size:
            e = held.popleft()
            out.append((*e[:3], -e[3], last))
        out.append(r[:5])
        held.append(r)
        last = r[4]
    if flush:
        out.extend((*e[:3], -e[3], last) for e in held)
    return out


@pytest.mark.parametrize("size", [1, 7, 300])
@pytest.mark.parametrize("flush", [False, True])
def test_count_window(spark, size, flush):
    out = wn.count_window(frame(spark, ROWS), size, flush).orderBy("ts", "seq").collect()
    got = [(r["sid"], r["hid"], r["key"], r["upd"], r["ts"]) for r in out]
    assert got == literal_count_window(ROWS, size, flush)


def test_count_window_rejects_size_zero(spark):
    with pytest.raises(ValueError):
        wn.count_window(frame(spark, ROWS), 0)


def test_site_count_window(spark):
    held, expected = {}, []
    for r in ROWS:
        buffer = held.setdefault(r[:2], deque())
        if len(buffer) == 5:
            e = buffer.popleft()
            expected.append((*e[:3], -e[3], r[4], r[5], -1))
        buffer.append(r)
        expected.append((*r, 0))
    out = wn.site_count_window(frame(spark, ROWS), 5)
    assert collect(out, "sid", "hid", "key", "upd", "ts", "seq", "slot") == sorted(expected)


def test_window_total_is_zero_after_flush(spark):
    out = wn.time_window(frame(spark, ROWS), 9, flush=True).groupBy("key").sum("upd").collect()
    assert {r[1] for r in out} == {0}


def test_loops(spark):
    rows = [(1, 1, 1, 1, t, t) for t in range(1, 101)]
    out = tr.loop_replay(frame(spark, rows), 10)
    assert collect(out, "ts") == [(t,) for t in range(1, 1001)]
    assert out.select("seq").distinct().count() == 1000
    with pytest.raises(ValueError):
        tr.loop_replay(frame(spark, rows), 0)


def test_prepare_rejects_two_windows():
    with pytest.raises(ValueError):
        tr.Preparation(time_window=5, fixed_window=5)
    with pytest.raises(ValueError):
        tr.Preparation(warmup_time=5, warmup_size=5)


def test_warmup_must_leave_something(spark):
    with pytest.raises(ValueError):
        tr.warmup_split(frame(spark, ROWS), size=len(ROWS), check=True)
    flags = tr.warmup_split(frame(spark, ROWS), size=10, check=True)
    assert flags.where("warmup").count() == 10


def test_max_length_by_position(spark):
    assert collect(tr.max_length(frame(spark, ROWS), 50), "seq") == [(i,) for i in range(50)]


def test_order_violations(spark):
    rows = [(0, 0, 1, 1, t, i) for i, t in enumerate([1, 2, 2, 5, 3, 9, 8, 8])]
    assert tr.order_violations(frame(spark, rows)).first()[0] == 2


def test_time_average_of_window(spark):
    rows = [(0, 0, 1, 1, 0, 0), (0, 0, 1, 1, 4, 1)]
    load = wn.window_load(wn.time_window(frame(spark, rows), 10, flush=True)).first()
    # One record is active on [0,4) and [10,14), two on [4,10).
    assert (load["max_size"], load["avg_size"]) == (2, (4 + 12 + 4) / 14)
