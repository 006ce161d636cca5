"""Drift-triggered monitoring: publications, guarded estimates, their logs and costs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.functions import scalars
from tallyflow.operators import monitor as mn
from tallyflow.operators.joinsize import JoinSizeQuery, selfjoin_running
from tallyflow.operators.sampling import level_changed
from tallyflow.plans.catalog.base import DAY, EV, PROJ, hashed_cte, query, seeds_cte, with_
from tallyflow.plans.catalog.guarding import _BETA, _bilinear_sql, _high, _low
from tallyflow.session import cut_lineage, shared_folder
from tallyflow.sources.views import SITES, events_stream, table
from tallyflow.streaming.feeds import drain_batches, replay
from tallyflow.streaming.levels import LevelFilter
from tallyflow.streaming.protocols import DriftPublisher, GuardedEstimate, StreamedJoinSize

_THETA = 0.5
_EVERY = 2 * DAY
_LIMIT = _THETA * _THETA / SITES

_HASHED = seeds_cte() + ",\n" + hashed_cte("ev", "h")

_DRIFT_SQL = (
    _HASHED
    + f""",
s AS (SELECT sid, hid, ts // {_EVERY} AS slice, d, b, sum(sg * upd) AS c FROM h GROUP BY sid, hid, ts // {_EVERY}, d, b),
n AS (SELECT sid, hid, ts // {_EVERY} AS slice, count(*) AS n FROM ev GROUP BY sid, hid, ts // {_EVERY}),
cum AS (SELECT n.sid, n.hid, n.slice, s.d, s.b, sum(s.c) AS c FROM n JOIN s ON s.sid = n.sid AND s.hid = n.hid AND s.slice <= n.slice
        GROUP BY n.sid, n.hid, n.slice, s.d, s.b),
g AS (SELECT x.sid, x.hid, x.slice AS s1, y.slice AS s2, sum(x.c * y.c)::DOUBLE AS p FROM cum x JOIN cum y
      ON x.sid = y.sid AND x.hid = y.hid AND x.d = y.d AND x.b = y.b AND x.slice <= y.slice GROUP BY x.sid, x.hid, x.slice, y.slice),
tot AS (SELECT sid, hid, s1 AS slice, p AS total2 FROM g WHERE s1 = s2),
pairs AS (SELECT sid, hid, CAST(-1 AS BIGINT) AS last, slice, total2 AS drift2, total2 FROM tot UNION ALL
      SELECT g.sid, g.hid, g.s1, g.s2, a.total2 + b.total2 - 2 * g.p, b.total2 FROM g
      JOIN tot a ON a.sid = g.sid AND a.hid = g.hid AND a.slice = g.s1
      JOIN tot b ON b.sid = g.sid AND b.hid = g.hid AND b.slice = g.s2 WHERE g.s1 < g.s2),
nxt AS (SELECT sid, hid, last, min(slice) AS slice FROM pairs WHERE drift2 >= {_LIMIT!r} * total2 GROUP BY sid, hid, last),
pub AS (SELECT sid, hid, last, slice, CAST(1 AS BIGINT) AS publication FROM nxt WHERE last = -1 UNION ALL
      SELECT nxt.sid, nxt.hid, nxt.last, nxt.slice, pub.publication + 1 FROM pub JOIN nxt
      ON nxt.sid = pub.sid AND nxt.hid = pub.hid AND nxt.last = pub.slice),
log AS (SELECT p.sid, p.hid, p.slice, p.publication, CAST(sum(n.n) AS BIGINT) AS updates FROM pub p
      JOIN n ON n.sid = p.sid AND n.hid = p.hid AND n.slice > p.last AND n.slice <= p.slice GROUP BY p.sid, p.hid, p.slice, p.publication)"""
)


def _publications(spark, sf):
    return mn.drift_publish(events_stream(spark, sf), PROJ, _THETA, SITES, _EVERY)


@query(
    "drift_publish",
    with_(
        EV,
        _DRIFT_SQL,
        """SELECT log.sid, log.hid, log.slice, log.publication, log.updates, pairs.drift2 FROM log
        JOIN pub ON pub.sid = log.sid AND pub.hid = log.hid AND pub.slice = log.slice
        JOIN pairs ON pairs.sid = pub.sid AND pairs.hid = pub.hid AND pairs.last = pub.last AND pairs.slice = pub.slice""",
    ),
)
def drift_publish(spark, sf):
    return _publications(spark, sf).drop("cells", "values")


@query(
    "published_estimate",
    with_(
        EV,
        _DRIFT_SQL,
        """pt AS (SELECT DISTINCT sid, slice FROM log),
lst AS (SELECT pt.sid, pt.slice, log.hid, max(log.slice) AS p FROM pt JOIN log ON log.sid = pt.sid AND log.slice <= pt.slice
        GROUP BY pt.sid, pt.slice, log.hid),
cells AS (SELECT lst.sid, lst.slice, cum.d, cum.b, sum(cum.c) AS c FROM lst JOIN cum ON cum.sid = lst.sid AND cum.hid = lst.hid
        AND cum.slice = lst.p GROUP BY lst.sid, lst.slice, cum.d, cum.b),
r AS (SELECT sid, slice, d, sum(c * c)::DOUBLE AS r FROM cells GROUP BY sid, slice, d)""",
        "SELECT sid, slice, median(r) AS estimate FROM r GROUP BY sid, slice",
    ),
)
def published_estimate(spark, sf):
    return mn.published_estimate(cut_lineage(_publications(spark, sf)), PROJ)


@query(
    "publish_cost",
    with_(
        EV,
        _DRIFT_SQL,
        f"""SELECT sid, CAST(count(*) AS BIGINT) AS msgs, CAST(sum(updates) AS BIGINT) AS updates,
         CAST(sum(least({4 * PROJ.cells}, 4 * updates)) AS BIGINT) AS bytes,
         CAST(sum(least({4 * PROJ.cells}, 4 * updates) + 40 * ceil(least({4 * PROJ.cells}, 4 * updates) / 1024.0)) AS BIGINT) AS tcp_bytes,
         CAST(sum(least({4 * PROJ.cells}, 4 * updates)) AS DOUBLE) / max(raw) AS ratio
        FROM log JOIN (SELECT sid, 16 * count(*) AS raw FROM ev GROUP BY sid) t USING (sid) GROUP BY sid""",
    ),
)
def publish_cost(spark, sf):
    """Cost of the publication log, with its ratio to shipping every record."""
    cost = mn.publish_cost(_publications(spark, sf), PROJ)
    raw = events_stream(spark, sf).groupBy("sid").agg((F.count(F.lit(1)) * 16).alias("raw"))
    return cost.join(raw, "sid").withColumn("ratio", F.col("bytes") / F.col("raw")).drop("raw")


@query(
    "message_bytes",
    """SELECT o_orderkey, CAST(least(1940, 8 * (o_orderkey % 500)) AS BIGINT) AS bytes,
     CAST(least(1940, 8 * (o_orderkey % 500)) + 40 * ceil(least(1940, 8 * (o_orderkey % 500)) / 1024.0) AS BIGINT) AS tcp_bytes FROM orders""",
)
def message_bytes(spark, sf):
    """Size formulas on a table of update counts."""
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 500).alias("n"))
    o = o.select("o_orderkey", scalars.publish_bytes(F.col("n"), PROJ.cells).alias("bytes"))
    return o.withColumn("tcp_bytes", scalars.tcp_bytes(F.col("bytes")))


# -- guarded estimates --------------------------------------------------------------

_MK = (PROJ.depth + 1) // 2
_CELLS = PROJ.cells

_LEAST = f"""masks AS (SELECT CAST(i AS INTEGER) AS mask FROM range(1, {1 << PROJ.depth}) r(i))"""


def _quorum_sql(lanes: str, out: str) -> str:
    """CTE ``out``: the smallest normalised sum over all sets of l - k + 1 of the l rows of ``lanes`` (ze, zx, l, rn)."""
    return f"""{out}_m AS (SELECT q, a, t, hid, mask, sum(ze * zx) / sqrt(sum(ze * ze)) AS v FROM {lanes} JOIN masks
       ON mask < (1 << l) AND bit_count(mask) = l - {_MK} + 1 AND (mask >> (rn - 1)) & 1 = 1 GROUP BY q, a, t, hid, mask),
{out} AS (SELECT q, a, t, hid, min(v) AS z FROM {out}_m GROUP BY q, a, t, hid)"""


#: From the guards of sites (zs) and anchors to the log of rounds.
_CHAIN_SQL = f"""za AS (SELECT q, a, z AS zeta_anchor FROM zs WHERE t = -9),
ck AS (SELECT zs.q, zs.a, zs.t, zeta_anchor, least(min(z), CASE WHEN count(*) < {SITES} THEN zeta_anchor ELSE min(z) END) AS zeta_min,
         sum(z) + ({SITES} - count(*)) * zeta_anchor AS zeta_sum
       FROM zs JOIN za ON za.q = zs.q AND za.a = zs.a WHERE zs.t >= 0 GROUP BY zs.q, zs.a, zs.t, zeta_anchor),
fire AS (SELECT q, a, min(t) AS t FROM ck WHERE a = -1 OR RULE GROUP BY q, a),
anchors AS (SELECT q, a, t, CAST(1 AS BIGINT) AS round FROM fire WHERE a = -1 UNION ALL
       SELECT fire.q, fire.a, fire.t, anchors.round + 1 FROM anchors JOIN fire ON fire.q = anchors.q AND fire.a = anchors.t),
inforce AS (SELECT sl.q, sl.slice, coalesce(max(anchors.t), -1) AS a FROM sl LEFT JOIN anchors ON anchors.q = sl.q AND anchors.t < sl.slice
       GROUP BY sl.q, sl.slice),
sent AS (SELECT v.q, v.slice, sum(m) AS updates, sum(least(PAYLOAD, 8 * m)) AS bytes FROM (
       SELECT i.q, i.slice, n.hid, sum(n.n) AS m FROM inforce i JOIN n ON n.q = i.q AND n.slice > i.a AND n.slice <= i.slice
       GROUP BY i.q, i.slice, n.hid) v GROUP BY v.q, v.slice),
rounds AS (SELECT i.q, i.slice, CAST((SELECT count(*) FROM anchors WHERE anchors.q = i.q AND anchors.t <= i.slice) AS BIGINT) AS round,
       f.t IS NOT NULL AS reanchored, bb.estimate, bb.low, bb.high, ck.zeta_anchor, ck.zeta_min, ck.zeta_sum,
       CAST(CASE WHEN f.t IS NULL THEN 0 ELSE sent.updates END AS BIGINT) AS updates,
       CAST(CASE WHEN f.t IS NULL THEN 0 ELSE sent.bytes END AS BIGINT) AS bytes
     FROM inforce i LEFT JOIN anchors f ON f.q = i.q AND f.t = i.slice
     JOIN bb ON bb.q = i.q AND bb.a = CASE WHEN f.t IS NULL THEN i.a ELSE i.slice END
     JOIN ck ON ck.q = i.q AND ck.a = i.a AND ck.t = i.slice JOIN sent ON sent.q = i.q AND sent.slice = i.slice)"""

_GUARDED_SQL = ",\n".join(
    [
        _HASHED,
        _LEAST,
        f"""s AS (SELECT sid AS q, hid, ts // {_EVERY} AS slice, d, b, sum(sg * upd) AS c FROM h GROUP BY sid, hid, ts // {_EVERY}, d, b),
n AS (SELECT sid AS q, hid, ts // {_EVERY} AS slice, count(*) AS n FROM ev GROUP BY sid, hid, ts // {_EVERY}),
sl AS (SELECT DISTINCT q, slice FROM n),
lanes0 AS (SELECT q, CAST(i AS INTEGER) AS d FROM (SELECT DISTINCT q FROM n) x, range({PROJ.depth}) r(i)),
ea AS (SELECT q, CAST(-1 AS BIGINT) AS a, d, 0 AS b, CAST(0 AS HUGEINT) AS c FROM lanes0 UNION ALL
       SELECT sl.q, sl.slice, d, b, sum(c) FROM sl JOIN s ON s.q = sl.q AND s.slice <= sl.slice GROUP BY sl.q, sl.slice, d, b),
en AS (SELECT q, a, d, sum(c * c)::DOUBLE AS e2 FROM ea GROUP BY q, a, d),
es AS (SELECT q, a, median(e2) AS estimate FROM en GROUP BY q, a),
bb AS (SELECT q, a, estimate, {_low('estimate')} AS low, {_high('estimate')} AS high FROM es),
pt AS (SELECT bb.q, bb.a, sl.slice AS t FROM bb JOIN sl ON sl.q = bb.q AND sl.slice > bb.a),
u AS (SELECT pt.q, pt.a, pt.t, s.hid, s.d, s.b, sum(s.c) AS c FROM pt JOIN s ON s.q = pt.q AND s.slice > pt.a AND s.slice <= pt.t
      GROUP BY pt.q, pt.a, pt.t, s.hid, s.d, s.b),
site AS (SELECT DISTINCT q, a, t, hid FROM u),
x AS (SELECT q, a, t, hid, d, b, sum(c) AS c FROM (
        SELECT site.q, site.a, site.t, site.hid, ea.d, ea.b, ea.c FROM site JOIN ea ON ea.q = site.q AND ea.a = site.a UNION ALL
        SELECT q, a, t, hid, d, b, {SITES} * c FROM u) z GROUP BY q, a, t, hid, d, b),
ln AS (SELECT x.q, x.a, x.t, x.hid, x.d, sum(x.c * x.c)::DOUBLE AS x2, sum(x.c * coalesce(ea.c, 0))::DOUBLE AS xe
       FROM x LEFT JOIN ea ON ea.q = x.q AND ea.a = x.a AND ea.d = x.d AND ea.b = x.b GROUP BY x.q, x.a, x.t, x.hid, x.d
       UNION ALL SELECT q, a, CAST(-9 AS BIGINT), -9, d, e2, e2 FROM en),
up AS (SELECT ln.q, ln.a, ln.t, ln.hid, ln.d, sqrt(high) - sqrt(e2) AS ze, sqrt(high) - sqrt(x2) AS zx
       FROM ln JOIN en ON en.q = ln.q AND en.a = ln.a AND en.d = ln.d JOIN bb ON bb.q = ln.q AND bb.a = ln.a),
lo AS (SELECT ln.q, ln.a, ln.t, ln.hid, ln.d, sqrt(e2) - sqrt(low) AS ze, xe / sqrt(e2) - sqrt(low) AS zx
       FROM ln JOIN en ON en.q = ln.q AND en.a = ln.a AND en.d = ln.d JOIN bb ON bb.q = ln.q AND bb.a = ln.a WHERE low > 0 AND e2 > 0),
ug AS (SELECT *, count(*) OVER w AS l, row_number() OVER (PARTITION BY q, a, t, hid ORDER BY d) AS rn FROM up WHERE ze > 0
       WINDOW w AS (PARTITION BY q, a, t, hid)),
lg AS (SELECT *, count(*) OVER w AS l, row_number() OVER (PARTITION BY q, a, t, hid ORDER BY d) AS rn FROM lo WHERE ze > 0
       WINDOW w AS (PARTITION BY q, a, t, hid))""",
        _quorum_sql("ug", "zu"),
        _quorum_sql("lg", "zl"),
        """zs AS (SELECT zu.q, zu.a, zu.t, zu.hid, least(zu.z, coalesce(zl.z, zu.z)) AS z FROM zu
       LEFT JOIN zl ON zl.q = zu.q AND zl.a = zu.a AND zl.t = zu.t AND zl.hid = zu.hid)""",
        _CHAIN_SQL.replace("PAYLOAD", str(4 * _CELLS)),
    ]
)

_RULE_SQL = {"any_site": "zeta_min <= 0", "sum": f"zeta_sum < {0.01 * SITES!r} * zeta_anchor"}
_ROUND_COLUMNS = """slice, round, reanchored, estimate, round(low, 3) AS low, round(high, 3) AS high, updates, bytes,
 round(zeta_anchor, 1) AS zeta_anchor, round(zeta_min, 1) AS zeta_min, round(zeta_sum, 1) AS zeta_sum FROM rounds"""
_ROUND_SQL = f"SELECT 'selfjoin(' || q || ')' AS query, {_ROUND_COLUMNS}"

#: Every stream is watched, all in one pass.
_QUERIES = [JoinSizeQuery(sid, beta=_BETA) for sid in range(5)]


def _guarded(rule: str) -> str:
    return _GUARDED_SQL.replace("RULE", _RULE_SQL[rule])


def _rounds(spark, sf, rule):
    return mn.monitor_all(events_stream(spark, sf), _QUERIES, PROJ, SITES, _EVERY, rule)


def _rounded(rounds):
    keep = {c: F.round(c, 3) for c in ("low", "high")} | {c: F.round(c, 1) for c in ("zeta_anchor", "zeta_min", "zeta_sum")}
    return rounds.withColumns(keep)


@query("monitor_any_site", with_(EV, _guarded("any_site"), _ROUND_SQL))
def monitor_any_site(spark, sf):
    return _rounded(_rounds(spark, sf, "any_site"))


@query("monitor_sum", with_(EV, _guarded("sum"), _ROUND_SQL))
def monitor_sum(spark, sf):
    return _rounded(_rounds(spark, sf, "sum"))


def _join_guard(out: str, xi: str, psi: str, t: str, x: str, y: str) -> str:
    """CTE ``out``: (id, zeta) of all lanes for one bound of the product."""
    rows = f"{out}_g AS (SELECT id, {xi} AS xi, {psi} AS psi, {t} AS t, {x} AS x, {y} AS y FROM lanes)"
    return rows + ",\n" + _bilinear_sql(f"{out}_g", out)


def _join_quorum(out: str, site: str, anchor: str) -> str:
    """CTE ``out``: (q, a, t, hid, z), the exact quorum of the rows with a positive anchor guard."""
    return f"""{out}_p AS (SELECT l.q, l.a, l.t, l.hid, e.zeta / sqrt(2) AS ze, x.zeta / sqrt(2) AS zx, l.d FROM lanes l JOIN {site} x ON x.id = l.id
       JOIN {anchor} e ON e.id = l.id WHERE e.zeta > 0),
{out}_r AS (SELECT *, count(*) OVER (PARTITION BY q, a, t, hid) AS l, row_number() OVER (PARTITION BY q, a, t, hid ORDER BY d) AS rn FROM {out}_p),
""" + _quorum_sql(f"{out}_r", out)


_PAIR_GUARDED_SQL = ",\n".join(
    [
        _HASHED,
        _LEAST,
        f"""s AS (SELECT 0 AS q, hid, ts // {_EVERY} AS slice, d, b, sum(CASE WHEN sid = 0 THEN sg * upd ELSE 0 END) AS c1,
        sum(CASE WHEN sid = 4 THEN sg * upd ELSE 0 END) AS c2 FROM h WHERE sid IN (0, 4) GROUP BY hid, ts // {_EVERY}, d, b)""",
        f"n AS (SELECT 0 AS q, hid, ts // {_EVERY} AS slice, count(*) AS n FROM ev WHERE sid IN (0, 4) GROUP BY hid, ts // {_EVERY})",
        f"""sl AS (SELECT DISTINCT q, slice FROM n),
lanes0 AS (SELECT CAST(i AS INTEGER) AS d FROM range({PROJ.depth}) r(i)),
ea AS (SELECT CAST(-1 AS BIGINT) AS a, d, 0 AS b, CAST(0 AS HUGEINT) AS c1, CAST(0 AS HUGEINT) AS c2 FROM lanes0 UNION ALL
       SELECT sl.slice, d, b, sum(c1), sum(c2) FROM sl JOIN s ON s.slice <= sl.slice GROUP BY sl.slice, d, b),
en AS (SELECT a, d, sqrt(sum((c1 + c2) * (c1 + c2))::DOUBLE) AS pe, sqrt(sum((c1 - c2) * (c1 - c2))::DOUBLE) AS me,
         sum(c1 * c2)::DOUBLE AS dot FROM ea GROUP BY a, d),
es AS (SELECT a, median(dot) AS estimate FROM en GROUP BY a),
bb AS (SELECT 0 AS q, a, estimate, {_low('estimate')} AS low, {_high('estimate')} AS high FROM es),
pt AS (SELECT bb.a, sl.slice AS t FROM bb JOIN sl ON sl.slice > bb.a),
u AS (SELECT pt.a, pt.t, s.hid, s.d, s.b, sum(s.c1) AS c1, sum(s.c2) AS c2 FROM pt JOIN s ON s.slice > pt.a AND s.slice <= pt.t
      GROUP BY pt.a, pt.t, s.hid, s.d, s.b),
site AS (SELECT DISTINCT a, t, hid FROM u),
x AS (SELECT a, t, hid, d, b, sum(c1) AS c1, sum(c2) AS c2 FROM (
        SELECT site.a, site.t, site.hid, ea.d, ea.b, ea.c1, ea.c2 FROM site JOIN ea ON ea.a = site.a UNION ALL
        SELECT a, t, hid, d, b, {SITES} * c1, {SITES} * c2 FROM u) z GROUP BY a, t, hid, d, b),
l0 AS (SELECT x.a, x.t, x.hid, x.d, sqrt(sum((x.c1 + x.c2) * (x.c1 + x.c2))::DOUBLE) AS px, sqrt(sum((x.c1 - x.c2) * (x.c1 - x.c2))::DOUBLE) AS mx,
         sum((x.c1 + x.c2) * (coalesce(ea.c1, 0) + coalesce(ea.c2, 0)))::DOUBLE AS pxe,
         sum((x.c1 - x.c2) * (coalesce(ea.c1, 0) - coalesce(ea.c2, 0)))::DOUBLE AS mxe
       FROM x LEFT JOIN ea ON ea.a = x.a AND ea.d = x.d AND ea.b = x.b GROUP BY x.a, x.t, x.hid, x.d
       UNION ALL SELECT a, CAST(-9 AS BIGINT), -9, d, pe, me, pe * pe, me * me FROM en),
lanes AS (SELECT l0.*, 0 AS q, row_number() OVER () AS id, en.pe, en.me, bb.low, bb.high,
            CASE WHEN en.pe > 0 THEN l0.pxe / en.pe ELSE 0 END AS pa, CASE WHEN en.me > 0 THEN l0.mxe / en.me ELSE 0 END AS ma
          FROM l0 JOIN en ON en.a = l0.a AND en.d = l0.d JOIN bb ON bb.a = l0.a)""",
        _join_guard("lx", "pe", "me", "4 * low", "pa", "mx"),
        _join_guard("le", "pe", "me", "4 * low", "pe", "me"),
        _join_guard("hx", "me", "pe", "-4 * high", "ma", "px"),
        _join_guard("he", "me", "pe", "-4 * high", "me", "pe"),
        _join_quorum("zl", "lx", "le"),
        _join_quorum("zu", "hx", "he"),
        "zs AS (SELECT zu.q, zu.a, zu.t, zu.hid, least(zu.z, zl.z) AS z FROM zu JOIN zl ON zl.a = zu.a AND zl.t = zu.t AND zl.hid = zu.hid)",
        # The chain of anchors and the log of rounds are the same as for one stream.
        _CHAIN_SQL.replace("PAYLOAD", str(8 * _CELLS)),
    ]
)


@query("monitor_join", with_(EV, _PAIR_GUARDED_SQL.replace("RULE", _RULE_SQL["any_site"]), f"SELECT {_ROUND_COLUMNS}"))
def monitor_join(spark, sf):
    """The any-site rule for the join of two streams, with the exact quorum."""
    q = JoinSizeQuery(0, 4, beta=_BETA)
    return _rounded(mn.monitor(events_stream(spark, sf), q, PROJ, SITES, _EVERY, "any_site"))


@query(
    "gm_summary",
    with_(
        EV,
        _guarded("sum"),
        f"""SELECT 'selfjoin(' || q || ')' AS run_id, 'sum' AS protocol, CAST({_BETA} AS DOUBLE) AS max_error, CAST({_CELLS} AS BIGINT) AS statevec_size,
         {SITES} AS sites, q AS sid, CAST(count(*) FILTER (WHERE reanchored) AS BIGINT) AS rounds, CAST(count(*) AS BIGINT) AS subrounds,
         CAST(sum(updates) AS BIGINT) AS updates_shipped, CAST(sum(bytes) AS BIGINT) AS bytes_shipped FROM rounds GROUP BY q""",
    ),
)
def gm_summary(spark, sf):
    return mn.monitor_summaries(_rounds(spark, sf, "sum"), _QUERIES, PROJ, SITES, "sum")


# -- streaming ------------------------------------------------------------------------


_VALUE_LEVELS = """s AS (SELECT sid, seq, ts, key AS f, row_number() OVER (PARTITION BY sid ORDER BY ts, seq) AS n FROM ev),
c AS (SELECT sid, n, f AS last FROM s WHERE n = 1 UNION ALL
      SELECT sid, n, f FROM (
        SELECT s.sid, s.n, s.f, row_number() OVER (PARTITION BY s.sid ORDER BY s.n) AS k
        FROM c JOIN s ON s.sid = c.sid AND s.n > c.n AND abs(s.f - c.last) > 0.5 * abs(c.last) + 30) t WHERE k = 1)"""
_LEVEL_ROWS = "SELECT s.sid, s.ts, s.seq, CAST(s.f AS DOUBLE) AS level FROM c JOIN s ON s.sid = c.sid AND s.n = c.n WHERE s.n > 1"


@query("stream_level_changed", with_(EV, _VALUE_LEVELS, _LEVEL_ROWS))
def stream_level_changed(spark, sf):
    """Keys that leave the band around the last one shown, over several micro-batches."""
    stream, folder = _slices(spark, sf), shared_folder(spark)
    levels = LevelFilter(spark, folder, stream.schema, "key", 0.5, 30.0)
    drain_batches(stream, levels.handle, folder)
    return levels.changes()


@query("level_changed_values", with_(EV, _VALUE_LEVELS, _LEVEL_ROWS))
def level_changed_values(spark, sf):
    """The same in batch."""
    return level_changed(events_stream(spark, sf).select("sid", "ts", "seq", "key"), "key", 0.5, 30.0)


_LONG = 9 * DAY


def _slowly(sql: str) -> str:
    """SQL of the batch form with long slices."""
    return sql.replace(f"// {_EVERY}", f"// {_LONG}")


def _slices(spark, sf):
    """The events as one micro-batch per long slice."""
    return replay(events_stream(spark, sf).withColumn("slice", mn.time_slice_of(_LONG)), "slice")


@query(
    "stream_drift_publish",
    with_(
        EV,
        _slowly(_DRIFT_SQL),
        """lst AS (SELECT sid, hid, max(slice) AS p, CAST(sum(updates) AS BIGINT) AS updates, count(*) AS n FROM log GROUP BY sid, hid),
cells AS (SELECT lst.sid, cum.d, cum.b, sum(cum.c) AS c FROM lst JOIN cum ON cum.sid = lst.sid AND cum.hid = lst.hid
        AND cum.slice = lst.p GROUP BY lst.sid, cum.d, cum.b),
r AS (SELECT sid, d, sum(c * c)::DOUBLE AS r FROM cells GROUP BY sid, d)""",
        "SELECT sid, median(r) AS estimate FROM r GROUP BY sid",
    ),
)
def stream_drift_publish(spark, sf):
    """Estimates from all that was published over several micro-batches, some of them without publication."""
    folder = shared_folder(spark)
    site = DriftPublisher(spark, folder, PROJ, _THETA, SITES)
    drain_batches(_slices(spark, sf), site.handle, folder)
    return site.estimate()


@query(
    "stream_monitor",
    with_(
        EV,
        _slowly(_guarded("any_site")),
        """SELECT 'selfjoin(' || q || ')' AS query, dense_rank() OVER (ORDER BY slice) - 1 AS batch, reanchored, estimate,
         round(low, 3) AS low, round(high, 3) AS high, updates, bytes FROM rounds""",
    ),
)
def stream_monitor(spark, sf):
    """Round logs of streaming monitors of every stream, one micro-batch per slice; the first one sets the anchors."""
    folders = {q: f"{shared_folder(spark)}-{q.left}" for q in _QUERIES}
    watch = {q: GuardedEstimate(spark, folder, q, PROJ, SITES, "any_site") for q, folder in folders.items()}

    def handle(batch, batch_id):
        for guard in watch.values():
            guard.handle(batch, batch_id)

    drain_batches(_slices(spark, sf), handle, shared_folder(spark))
    logs = [guard.rounds.all().withColumn("query", F.lit(str(q))) for q, guard in watch.items()]
    rounds = reduce(DataFrame.unionByName, logs).drop("v", "zeta_anchor", "zeta_min", "zeta_sum")
    return rounds.withColumns({c: F.round(c, 3) for c in ("low", "high")})


def _values_sql(left: int, right: int) -> tuple[str, ...]:
    """The query's exact and sketched value at the end of every long slice."""
    side = lambda v, k: f"sum(CASE WHEN sid = {k} THEN {v} ELSE 0 END)"
    return (
        EV,
        _HASHED,
        f"sl AS (SELECT DISTINCT ts // {_LONG} AS slice FROM ev)",
        f"""k AS (SELECT sl.slice, key, {side('upd', left)} AS x, {side('upd', right)} AS y FROM sl JOIN ev ON ev.ts // {_LONG} <= sl.slice GROUP BY sl.slice, key)""",
        f"""c AS (SELECT sl.slice, d, b, {side('sg * upd', left)} AS x, {side('sg * upd', right)} AS y FROM sl JOIN h ON h.ts // {_LONG} <= sl.slice GROUP BY sl.slice, d, b)""",
        "r AS (SELECT slice, d, sum(x * y)::DOUBLE AS r FROM c GROUP BY slice, d)",
        "m AS (SELECT slice, median(r) AS estimate FROM r GROUP BY slice)",
        """SELECT row_number() OVER (ORDER BY slice) - 1 AS batch, exact, estimate
        FROM (SELECT slice, CAST(sum(x * y) AS DOUBLE) AS exact FROM k GROUP BY slice) JOIN m USING (slice)""",
    )


def _streamed(spark, sf, q):
    folder = shared_folder(spark)
    size = StreamedJoinSize(spark, folder, q, PROJ)
    drain_batches(_slices(spark, sf), size.handle, folder)
    return size.values.all().drop("v")


_EVERY_VALUE = (
    EV,
    _HASHED,
    f"sl AS (SELECT DISTINCT ts // {_LONG} AS slice FROM ev)",
    f"k AS (SELECT sl.slice, sid, key, sum(upd) AS x FROM sl JOIN ev ON ev.ts // {_LONG} <= sl.slice GROUP BY sl.slice, sid, key)",
    f"c AS (SELECT sl.slice, sid, d, b, sum(sg * upd) AS x FROM sl JOIN h ON h.ts // {_LONG} <= sl.slice GROUP BY sl.slice, sid, d, b)",
    "r AS (SELECT slice, sid, d, sum(x * x)::DOUBLE AS r FROM c GROUP BY slice, sid, d)",
    "m AS (SELECT slice, sid, median(r) AS estimate FROM r GROUP BY slice, sid)",
    """SELECT sid, dense_rank() OVER (ORDER BY slice) - 1 AS batch, exact, estimate
    FROM (SELECT slice, sid, CAST(sum(x * x) AS DOUBLE) AS exact FROM k GROUP BY slice, sid) JOIN m USING (slice, sid)""",
)


@query("stream_selfjoin", with_(*_EVERY_VALUE))
def stream_selfjoin(spark, sf):
    """Self-join size of every stream after every micro-batch, exact and sketched."""
    sizes = {q.left: StreamedJoinSize(spark, f"{shared_folder(spark)}-{q.left}", q, PROJ) for q in _QUERIES}

    def handle(batch, batch_id):
        for size in sizes.values():
            size.handle(batch, batch_id)

    drain_batches(_slices(spark, sf), handle, shared_folder(spark))
    return reduce(DataFrame.unionByName, [x.values.all().drop("v").withColumn("sid", F.lit(sid)) for sid, x in sizes.items()])


@query("stream_join", with_(*_values_sql(0, 4)))
def stream_join(spark, sf):
    """Join size of two streams after every micro-batch, exact and sketched."""
    return _streamed(spark, sf, JoinSizeQuery(0, 4))


@query(
    "running_vs_anchored",
    with_(
        EV,
        """y0 AS (SELECT *, coalesce(sum(upd) OVER (PARTITION BY sid, key ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS y FROM ev)""",
        """r0 AS (SELECT sid, ts, seq, CAST(sum((2 * y + upd) * upd) OVER (PARTITION BY sid ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS v FROM y0)""",
        f"""le AS (SELECT sid, ts // {_EVERY} AS slice, max_by(v, seq) AS v FROM r0 GROUP BY sid, ts // {_EVERY})""",
        _guarded("any_site"),
        """SELECT le.sid, le.slice, le.v AS exact, rounds.estimate AS approx,
        CASE WHEN le.v = 0 THEN rounds.estimate ELSE abs((le.v - rounds.estimate) / le.v) END AS rel_error
        FROM le JOIN rounds ON rounds.q = le.sid AND rounds.slice = le.slice""",
    ),
)
def running_vs_anchored(spark, sf):
    """Error of the anchored estimate of every stream at each slice end, against the exact running value."""
    exact = selfjoin_running(events_stream(spark, sf)).groupBy("sid", mn.time_slice_of(_EVERY).alias("slice"))
    exact = exact.agg(F.max_by("estimate", F.struct("ts", "seq")).alias("estimate"))
    names = F.create_map(*[F.lit(v) for q in _QUERIES for v in (str(q), q.left)])
    anchored = _rounds(spark, sf, "any_site").withColumn("sid", names[F.col("query")])
    return mn.error_series(exact, anchored, ["sid", "slice"])
