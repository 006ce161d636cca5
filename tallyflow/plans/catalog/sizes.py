"""Join sizes, exact: batch, running, all pairs; and sampling of running series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyflow.operators import joinsize as js
from tallyflow.operators import sampling
from tallyflow.operators.frequency import frequency_vector
from tallyflow.operators.monitor import error_series
from tallyflow.operators.segments import Segments
from tallyflow.operators.sketch import selfjoin_estimate_running
from tallyflow.operators.windows import time_window
from tallyflow.plans.catalog.base import DAY, EV, LI, PROJ, query, with_
from tallyflow.plans.catalog.sketches import RUNNING_SELFJOIN_SQL
from tallyflow.session import cut_lineage
from tallyflow.sources.views import events_stream, lineitem_stream

_SELFJOIN = "f AS (SELECT sid, key, sum(upd) AS cnt FROM li GROUP BY sid, key)"


@query("selfjoin_exact", with_(LI, _SELFJOIN, "SELECT sid, CAST(sum(cnt * cnt) AS DOUBLE) AS selfjoin FROM f GROUP BY sid"))
def selfjoin_exact(spark, sf):
    return js.selfjoin_size(lineitem_stream(spark, sf))


@query(
    "join_exact",
    with_(
        LI,
        _SELFJOIN,
        """SELECT CAST(sum(a.cnt * b.cnt) AS DOUBLE) AS join_size
        FROM f a JOIN f b ON a.key = b.key WHERE a.sid = 0 AND b.sid = 1""",
    ),
)
def join_exact(spark, sf):
    return js.JoinSizeQuery(0, 1).exact(lineitem_stream(spark, sf))


_MATRIX = """SELECT a.sid AS sid1, b.sid AS sid2, CAST(sum(a.cnt * b.cnt) AS DOUBLE) AS join_size
FROM f a JOIN f b ON a.key = b.key AND a.sid <= b.sid GROUP BY a.sid, b.sid"""
_EV_FREQ = "f AS (SELECT sid, key, sum(upd) AS cnt FROM ev GROUP BY sid, key)"


@query("join_size_matrix", with_(EV, _EV_FREQ, _MATRIX))
def join_size_matrix(spark, sf):
    ev = events_stream(spark, sf)
    return js.join_size_matrix(ev, js.stream_ids(ev))


@query("join_size_matrix_open", with_(EV, _EV_FREQ, _MATRIX))
def join_size_matrix_open(spark, sf):
    """The same without knowing the stream ids beforehand."""
    return js.join_size_matrix(events_stream(spark, sf))


_RUNNING = """x AS (SELECT *, coalesce(sum(upd) OVER (PARTITION BY sid, key ORDER BY ts, kind, seq
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x FROM w),
r AS (SELECT sid, ts, kind, seq, CAST(sum((2 * x + upd) * upd) OVER (PARTITION BY sid ORDER BY ts, kind, seq
                ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS estimate FROM x)"""
_WINDOWED = f"""w AS (SELECT sid, hid, key, upd, ts, seq, 0 AS kind FROM ev UNION ALL
              SELECT sid, hid, key, -upd, ts + {7 * DAY}, seq, 1 FROM ev WHERE ts + {7 * DAY} < (SELECT max(ts) FROM ev))"""
_PLAIN = "w AS (SELECT *, 0 AS kind FROM ev)"


@query("selfjoin_running", with_(EV, _PLAIN, _RUNNING, "SELECT sid, ts, seq, estimate FROM r"))
def selfjoin_running(spark, sf):
    return js.selfjoin_running(events_stream(spark, sf))


@query("selfjoin_running_window", with_(EV, _WINDOWED, _RUNNING, "SELECT sid, ts, kind, seq, estimate FROM r"))
def selfjoin_running_window(spark, sf):
    """Over the last seven days: arrivals and expiries."""
    return js.selfjoin_running(time_window(events_stream(spark, sf), 7 * DAY))


_JOIN_RUNNING = """j AS (SELECT *, CASE sid WHEN 0 THEN upd ELSE 0 END AS u1, CASE sid WHEN 4 THEN upd ELSE 0 END AS u2
      FROM w WHERE sid IN (0, 4)),
a AS (SELECT *, sum(u1) OVER k AS a1, sum(u2) OVER k AS a2 FROM j
      WINDOW k AS (PARTITION BY key ORDER BY ts, kind, seq ROWS UNBOUNDED PRECEDING)),
r AS (SELECT ts, kind, seq, CAST(sum(u1 * a2 + u2 * a1) OVER (ORDER BY ts, kind, seq ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS estimate FROM a)"""


@query("join_running", with_(EV, _WINDOWED, _JOIN_RUNNING, "SELECT ts, kind, seq, estimate FROM r"))
def join_running(spark, sf):
    return js.JoinSizeQuery(0, 4).running(time_window(events_stream(spark, sf), 7 * DAY))


@query("every_nth", with_(EV, "r AS (SELECT *, row_number() OVER (ORDER BY ts, seq) AS n FROM ev)", "SELECT sid, hid, key, upd, ts, seq FROM r WHERE n % 7 = 0"))
def every_nth(spark, sf):
    return sampling.every_nth(events_stream(spark, sf), 7)


_SPREAD = """n AS (SELECT count(*) AS total FROM src),
s AS (SELECT CAST(0 AS BIGINT) AS j, CAST(0 AS BIGINT) AS p UNION ALL
      SELECT j + 1, p + (total - 1 - p) // (WANTED - 1 - j) FROM s, n WHERE j < WANTED - 1)"""


def _spread(source: str, wanted: int, order: str) -> str:
    return (
        _SPREAD.replace("src", source).replace("WANTED", str(wanted))
        + f",\nq AS (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS pos FROM {source})"
    )


@query("sample_n_of_N", with_(EV, _spread("ev", 333, "ts, seq"), "SELECT sid, hid, key, upd, ts, seq FROM q JOIN s ON q.pos = s.p"))
def sample_n_of_N(spark, sf):
    return sampling.sample_evenly(events_stream(spark, sf), 333)


@query(
    "sample_series",
    with_(
        EV,
        _PLAIN,
        _RUNNING,
        "v AS (SELECT ts, seq, estimate FROM r WHERE sid = 4)",
        _spread("v", 100, "ts, seq"),
        "SELECT ts, seq, estimate FROM q JOIN s ON q.pos = s.p",
    ),
)
def sample_series(spark, sf):
    """100 evenly spread points of the running self-join size of one stream."""
    mine = events_stream(spark, sf).where("sid = 4")
    seg = Segments.fit(mine)
    series = js.selfjoin_running(mine, seg)
    return sampling.sample_series(series, mine, 100, seg).select("ts", "seq", "estimate")


_LEVELS = """s AS (SELECT sid, seq, ts, estimate AS f, row_number() OVER (PARTITION BY sid ORDER BY ts, seq) AS n FROM r),
c AS (SELECT sid, n, f AS last FROM s WHERE n = 1 UNION ALL
      SELECT sid, n, f FROM (
        SELECT s.sid, s.n, s.f, row_number() OVER (PARTITION BY s.sid ORDER BY s.n) AS k
        FROM c JOIN s ON s.sid = c.sid AND s.n > c.n AND abs(s.f - c.last) > 0.1 * abs(c.last) + 5) t WHERE k = 1)"""


@query(
    "level_changed",
    with_(EV, _PLAIN, _RUNNING, _LEVELS, "SELECT s.sid, s.ts, s.seq, s.f AS level FROM c JOIN s ON s.sid = c.sid AND s.n = c.n WHERE s.n > 1"),
)
def level_changed(spark, sf):
    """Points where the running self-join size moved by more than 10 % + 5."""
    series = js.selfjoin_running(events_stream(spark, sf)).select("sid", "ts", "seq", "estimate")
    return sampling.level_changed(series, "estimate", 0.1, 5.0)


@query(
    "estimate_error_series",
    with_(
        EV,
        _PLAIN,
        _RUNNING,
        RUNNING_SELFJOIN_SQL,
        """SELECT r.sid, r.ts, r.seq, r.estimate AS exact, e.estimate AS approx,
         CASE WHEN r.estimate = 0 THEN e.estimate ELSE abs((r.estimate - e.estimate) / r.estimate) END AS rel_error
        FROM r JOIN e ON e.sid = r.sid AND e.seq = r.seq""",
    ),
)
def estimate_error_series(spark, sf):
    ev = events_stream(spark, sf)
    seg = Segments.fit(ev)
    exact = js.selfjoin_running(ev, seg)
    return error_series(exact, selfjoin_estimate_running(ev, PROJ, seg), ["sid", "ts", "seq"])


@query(
    "query_text",
    with_(
        EV,
        _EV_FREQ,
        """SELECT 'join(' || a.sid || ',' || b.sid || ')' AS query, CAST(sum(a.cnt * b.cnt) AS DOUBLE) AS answer
        FROM f a JOIN f b ON a.key = b.key WHERE a.sid < b.sid GROUP BY a.sid, b.sid
        UNION ALL SELECT 'selfjoin(' || sid || ')', CAST(sum(cnt * cnt) AS DOUBLE) FROM f GROUP BY sid""",
    ),
)
def query_text(spark, sf):
    """Query objects over all pairs of streams, with their answers from one shared frequency table."""
    freq = cut_lineage(frequency_vector(events_stream(spark, sf)).withColumnRenamed("cnt", "upd"))
    out = None
    for a in range(5):
        for b in range(a, 5):
            q = js.JoinSizeQuery(a, b)
            answer = q.exact(freq)
            row = answer.select(F.lit(str(q)).alias("query"), F.col(answer.columns[-1]).alias("answer"))
            out = row if out is None else out.unionByName(row)
    return out
