"""Guard values of sites against an anchored estimate.

Set-up shared by the queries: stream 0 of ``lineitem`` (and stream 1 for joins)
up to a cut date is the anchor; each host's later records are its drift.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyflow.functions import bounds
from tallyflow.operators import guards as gd
from tallyflow.operators import sketch as sk
from tallyflow.plans.catalog.base import EV, LI, PROJ, hashed_cte, query, seeds_cte, with_
from tallyflow.session import cut_lineage
from tallyflow.sources.views import SITES, events_stream, lineitem_stream, table

_CUT = 10500
_BETA = 0.6
_EPS = PROJ.epsilon
_K = gd.majority(PROJ.depth)


def _low(q: str) -> str:
    return f"CASE WHEN {q} > 0 THEN {q} - {_BETA - _EPS!r} * abs({q}) / {1 + _BETA!r} ELSE -1.0 END"


def _high(q: str) -> str:
    return f"CASE WHEN {q} > 0 THEN {q} + {_BETA - _EPS!r} * abs({q}) / {1 - _BETA!r} ELSE 1.0 END"


# -- bounds ---------------------------------------------------------------------


@query(
    "tods_error_bound",
    f"""SELECT DISTINCT l_discount AS theta, round({_EPS!r} + pow(1 + {_EPS!r}, 2) * (2 * l_discount + l_discount * l_discount), 6) AS bound
    FROM lineitem""",
)
def tods_error_bound(spark, sf):
    thetas = table(spark, sf, "lineitem").select(F.col("l_discount").alias("theta")).distinct()
    return thetas.select("theta", F.round(bounds.publish_error_bound(F.lit(_EPS), F.col("theta")), 6).alias("bound"))


_EST = """q AS (SELECT sid, d, CAST(sum(c * c) AS DOUBLE) AS r FROM s GROUP BY sid, d),
m AS (SELECT sid, median(r) AS estimate FROM q GROUP BY sid)"""


@query(
    "admissible_bounds",
    with_(
        EV,
        seeds_cte(),
        hashed_cte("ev", "h"),
        "s AS (SELECT sid, d, b, sum(sg * upd) AS c FROM h GROUP BY sid, d, b)",
        _EST,
        f"SELECT sid, estimate, round({_low('estimate')}, 6) AS low, round({_high('estimate')}, 6) AS high FROM m",
    ),
)
def admissible_bounds(spark, sf):
    est = sk.selfjoin_estimate(sk.sketch(events_stream(spark, sf), PROJ), PROJ)
    q = F.col("estimate")
    return est.withColumns(
        {
            "low": F.round(bounds.admissible_low(q, _BETA, _EPS), 6),
            "high": F.round(bounds.admissible_high(q, _BETA, _EPS), 6),
        }
    )


# -- self-join guards -------------------------------------------------------------

_SITES_SQL = (
    seeds_cte()
    + ",\n"
    + hashed_cte("li", "h")
    + f""",
e AS (SELECT sid, d, b, sum(sg * upd) AS c FROM h WHERE ts < {_CUT} GROUP BY sid, d, b),
u AS (SELECT sid, hid, d, b, sum(sg * upd) AS c FROM h WHERE ts >= {_CUT} GROUP BY sid, hid, d, b),
hosts AS (SELECT DISTINCT sid, hid FROM u),
x AS (SELECT sid, hid, d, b, sum(c) AS c FROM (SELECT e.sid, hid, d, b, c FROM hosts JOIN e ON e.sid = hosts.sid UNION ALL
      SELECT sid, hid, d, b, {SITES} * c FROM u) t GROUP BY sid, hid, d, b),
n AS (SELECT sid, d, CAST(sum(c * c) AS DOUBLE) AS e2 FROM e GROUP BY sid, d),
a AS (SELECT sid, median(e2) AS q FROM n GROUP BY sid),
bb AS (SELECT sid, {_low('q')} AS low, {_high('q')} AS high FROM a),
l0 AS (SELECT x.sid, x.hid, x.d, CAST(sum(x.c * x.c) AS DOUBLE) AS x2, CAST(sum(x.c * coalesce(e.c, 0)) AS DOUBLE) AS xe
      FROM x LEFT JOIN e ON e.sid = x.sid AND e.d = x.d AND e.b = x.b GROUP BY x.sid, x.hid, x.d),
lanes AS (SELECT l0.*, n.e2, low, high FROM l0 JOIN n ON n.sid = l0.sid AND n.d = l0.d JOIN bb ON bb.sid = l0.sid),
up AS (SELECT sid, hid, d, sqrt(high) - sqrt(x2) AS zx, sqrt(high) - sqrt(e2) AS ze FROM lanes),
lo AS (SELECT sid, hid, d, xe / sqrt(e2) - sqrt(low) AS zx, sqrt(e2) - sqrt(low) AS ze FROM lanes)"""
)

_BY = ["sid", "hid"]


def _exact(lanes: str, out: str, by: str = "hid") -> str:
    """CTEs for the exact quorum: subsets of legal rows as bit masks."""
    return f"""{out}_g AS (SELECT *, count(*) OVER (PARTITION BY {by}) AS l FROM {lanes} WHERE ze > 0),
{out}_m AS (SELECT {by}, m, l, count(*) AS n, sum(ze * zx) / sqrt(sum(ze * ze)) AS v FROM {out}_g, range(1, {1 << PROJ.depth}) r(m)
        WHERE (m >> d) & 1 = 1 GROUP BY {by}, m, l),
{out} AS (SELECT {by}, min(v) AS zeta FROM {out}_m WHERE n = bit_count(m) AND n = l - {_K} + 1 GROUP BY {by})"""


def _fast(lanes: str, out: str, by: str = "hid") -> str:
    return f"""{out}_g AS (SELECT *, count(*) OVER (PARTITION BY {by}) AS l,
        row_number() OVER (PARTITION BY {by} ORDER BY ze * zx) AS rn FROM {lanes} WHERE ze > 0),
{out} AS (SELECT {by}, sum(ze * zx) AS zeta FROM {out}_g WHERE rn <= l - {_K} + 1 GROUP BY {by})"""


def _cells(li, by):
    """Sketches before and after the cut per host: one pass, kept as a small table."""
    phased = li.withColumn("late", F.col("ts") >= _CUT)
    return cut_lineage(sk.sketch(phased, PROJ, ["late", "hid", *by]))


def _setup(spark, sf):
    """Site lanes with the bounds of their stream, and anchor and drift of every stream."""
    cells = _cells(lineitem_stream(spark, sf), ["sid"])
    anchor = sk.merge(cells.where("not late"), ["late", "hid"])
    drift = cells.where("late").drop("late")
    q = F.col("estimate")
    limits = sk.selfjoin_estimate(anchor, PROJ, ["sid"]).select(
        "sid",
        (q - (_BETA - _EPS) * F.abs(q) / (1 + _BETA)).alias("low"),
        (q + (_BETA - _EPS) * F.abs(q) / (1 - _BETA)).alias("high"),
    )
    sites = gd.site_states(anchor, drift, SITES, group=["sid"])
    return gd.site_lanes(sites, anchor, PROJ, _BY, ["sid"]).join(limits, "sid"), limits, anchor, drift


def _rounded(df, by=_BY):
    return df.select(*by, F.round("zeta", 4).alias("zeta"))


_GROUP = "sid, hid"
_ZETA = "SELECT sid, hid, round(zeta, 4) AS zeta FROM z"


@query("guard_selfjoin_upper", with_(LI, _SITES_SQL, _exact("up", "z", _GROUP), _ZETA))
def guard_selfjoin_upper(spark, sf):
    lanes, *_ = _setup(spark, sf)
    return _rounded(gd.guard_selfjoin_upper(lanes, F.col("high"), PROJ, _BY))


@query("guard_selfjoin_lower", with_(LI, _SITES_SQL, _exact("lo", "z", _GROUP), _ZETA))
def guard_selfjoin_lower(spark, sf):
    lanes, *_ = _setup(spark, sf)
    return _rounded(gd.guard_selfjoin_lower(lanes, F.col("low"), PROJ, _BY))


@query(
    "guard_selfjoin",
    with_(LI, _SITES_SQL, _exact("up", "zu", _GROUP), _exact("lo", "zl", _GROUP),
          "SELECT sid, hid, round(least(zu.zeta, zl.zeta), 4) AS zeta FROM zu JOIN zl USING (sid, hid)"),
)
def guard_selfjoin(spark, sf):
    lanes, *_ = _setup(spark, sf)
    return _rounded(gd.guard_selfjoin(lanes, F.col("low"), F.col("high"), PROJ, _BY))


@query("quorum_fast", with_(LI, _SITES_SQL, _fast("up", "z", _GROUP), "SELECT sid, hid, round(zeta, 1) AS zeta FROM z"))
def quorum_fast(spark, sf):
    lanes, *_ = _setup(spark, sf)
    out = gd.quorum_fast(gd.upper_lanes(lanes, F.col("high")), _K, _BY)
    return out.select(*_BY, F.round("zeta", 1).alias("zeta"))


@query("quorum_exact", with_(LI, _SITES_SQL, _exact("lo", "z", _GROUP), _ZETA))
def quorum_exact(spark, sf):
    lanes, *_ = _setup(spark, sf)
    return _rounded(gd.quorum_exact(gd.lower_lanes(lanes, F.col("low")), PROJ.depth, _K, _BY))


@query(
    "guard_ball",
    with_(
        LI,
        _SITES_SQL,
        "ue AS (SELECT n.sid, 0 AS hid, d, sqrt(high) - sqrt(e2) AS zx, sqrt(high) - sqrt(e2) AS ze FROM n JOIN bb ON bb.sid = n.sid)",
        "le AS (SELECT n.sid, 0 AS hid, d, sqrt(e2) - sqrt(low) AS zx, sqrt(e2) - sqrt(low) AS ze FROM n JOIN bb ON bb.sid = n.sid)",
        _exact("ue", "zu", _GROUP),
        _exact("le", "zl", _GROUP),
        "ze AS (SELECT zu.sid, least(zu.zeta, zl.zeta) AS zeta FROM zu JOIN zl ON zl.sid = zu.sid)",
        f"""SELECT u.sid, hid, round(max(ze.zeta) - sqrt(CAST(sum({SITES} * c * {SITES} * c) AS DOUBLE)), 4) AS zeta
        FROM u JOIN ze ON ze.sid = u.sid GROUP BY u.sid, hid""",
    ),
)
def guard_ball(spark, sf):
    _, limits, anchor, drift = _setup(spark, sf)
    own = gd.site_lanes(anchor.withColumn("hid", F.lit(0)), anchor, PROJ, _BY, ["sid"]).join(limits, "sid")
    at_anchor = gd.guard_selfjoin(own, F.col("low"), F.col("high"), PROJ, _BY).select("sid", F.col("zeta").alias("at_anchor"))
    norms = sk.sketch_norm(sk.scale(drift, SITES), _BY).join(at_anchor, "sid")
    return _rounded(norms.withColumn("zeta", gd.guard_ball(F.col("at_anchor"), F.col("norm"))))


@query(
    "update_scaling",
    with_(
        LI,
        seeds_cte(),
        hashed_cte("li", "h"),
        "SELECT d, b, CAST(sum(sg * upd) AS DOUBLE) AS c FROM h GROUP BY d, b",
    ),
)
def update_scaling(spark, sf):
    """The mean over sites of their scaled states, which is the state of the whole stream."""
    li = lineitem_stream(spark, sf)
    scaled = sk.scale(sk.sketch(li, PROJ, ["hid"]), SITES)
    return scaled.groupBy("d", "b").agg((F.sum("c") / SITES).alias("c"))


# -- bilinear guards --------------------------------------------------------------


def _foot_sql(rows: str, out: str) -> str:
    """CTE ``out``: rows (id, p, q, t) with the x of the nearest point of y = sqrt(x^2 + t).

    For t > 0, x = sqrt(t) (w - 1/w) / 2 turns the condition into the polynomial
    c w^4 - (|p| + q) w^3 - (|p| - q) w - c = 0 with c = sqrt(t); its largest root is
    approached from the right, where it is convex.
    """
    value = "c * pow(w, 4) - (p + q) * pow(w, 3) - (p - q) * w - c"
    slope = "4 * c * pow(w, 3) - 3 * (p + q) * pow(w, 2) - (p - q)"
    return f"""{out}_w AS (SELECT id, abs(p) AS p, q, sqrt(t) AS c, (abs(p) + abs(q)) / sqrt(t) + 2 AS w, 0 AS n
           FROM {rows} WHERE t > 0
     UNION ALL
     SELECT id, p, q, c, CASE WHEN {slope} > 0 THEN greatest(1, w - ({value}) / ({slope})) ELSE w END, n + 1
     FROM {out}_w WHERE n < 90),
{out} AS (SELECT r.id, CASE WHEN r.p < 0 THEN -1 ELSE 1 END *
       CASE WHEN r.t > 0 THEN s.c * (s.w - 1 / s.w) / 2 ELSE greatest(abs(r.p) + r.q, 0) / 2 END AS v
   FROM {rows} r LEFT JOIN (SELECT * FROM {out}_w WHERE n = 90) s ON s.id = r.id)"""


def _bilinear_sql(rows: str, out: str) -> str:
    """CTE ``out``: rows (id, xi, psi, t, x, y) with their guard value."""
    return f"""{out}_in AS (SELECT id, y AS p, x * sign(xi) AS q, t FROM {rows} WHERE t > 0),
{out}_below AS (SELECT id, xi AS p, abs(psi) AS q, -t AS t FROM {rows} WHERE t <= 0),
{_foot_sql(out + '_in', out + '_a')},
{_foot_sql(out + '_below', out + '_b')},
{out} AS (
  SELECT r.id, CASE WHEN r.x * sign(r.xi) >= sqrt(r.y * r.y + r.t) THEN 1 ELSE -1 END *
      sqrt(pow(n.v - r.y, 2) + pow(sqrt(n.v * n.v + r.t) - r.x * sign(r.xi), 2)) AS zeta
  FROM {rows} r JOIN {out}_a n ON n.id = r.id
  UNION ALL
  SELECT id, CASE WHEN h > 0 THEN (v * (x - v) - h * (abs(y) - h)) / sqrt(v * v + h * h)
                  ELSE (CASE WHEN xi >= 0 THEN x ELSE -x END - abs(y)) / sqrt(2.0) END
  FROM (SELECT r.*, n.v, sqrt(n.v * n.v - r.t) AS h FROM {rows} r JOIN {out}_b n ON n.id = r.id))"""


@query(
    "guard_bilinear",
    with_(
        """z0 AS (SELECT o_orderkey AS id, o_totalprice / 1000.0 AS xi, (o_custkey % 100) / 10.0 AS psi,
              CAST(o_orderkey % 3 - 1 AS DOUBLE) * 25 AS t, (o_custkey % 700) / 2.0 AS x, (o_orderkey % 90) / 3.0 AS y FROM orders)""",
        _bilinear_sql("z0", "z"),
        "SELECT id, round(zeta, 6) AS zeta FROM z",
    ),
)
def guard_bilinear(spark, sf):
    """Guards of points against references, with negative, zero and positive bounds."""
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_totalprice") / 1000.0).alias("xi"),
        ((F.col("o_custkey") % 100) / 10.0).alias("psi"),
        ((F.col("o_orderkey") % 3 - 1).cast("double") * 25).alias("t"),
        ((F.col("o_custkey") % 700) / 2.0).alias("x"),
        ((F.col("o_orderkey") % 90) / 3.0).alias("y"),
    )
    c = F.col
    return o.select("id", F.round(gd.guard_bilinear(c("xi"), c("psi"), c("t"), c("x"), c("y")), 6).alias("zeta"))


_PAIR_SQL = (
    seeds_cte()
    + ",\n"
    + hashed_cte("li", "h")
    + f""",
e AS (SELECT d, b, sum(CASE sid WHEN 0 THEN sg * upd ELSE 0 END) AS c1, sum(CASE sid WHEN 1 THEN sg * upd ELSE 0 END) AS c2
      FROM h WHERE ts < {_CUT} GROUP BY d, b),
u AS (SELECT hid, d, b, sum(CASE sid WHEN 0 THEN sg * upd ELSE 0 END) AS c1, sum(CASE sid WHEN 1 THEN sg * upd ELSE 0 END) AS c2
      FROM h WHERE ts >= {_CUT} GROUP BY hid, d, b),
hosts AS (SELECT DISTINCT hid FROM u),
x AS (SELECT hid, d, b, sum(c1) AS c1, sum(c2) AS c2 FROM (SELECT hid, d, b, c1, c2 FROM hosts CROSS JOIN e UNION ALL
      SELECT hid, d, b, {SITES} * c1, {SITES} * c2 FROM u) t GROUP BY hid, d, b),
n AS (SELECT d, sqrt(sum((c1 + c2) * (c1 + c2))::DOUBLE) AS pe, sqrt(sum((c1 - c2) * (c1 - c2))::DOUBLE) AS me, sum(c1 * c2)::DOUBLE AS dot
      FROM e GROUP BY d),
a AS (SELECT median(dot) AS q FROM n),
bb AS (SELECT {_low('q')} AS low, {_high('q')} AS high FROM a),
l0 AS (SELECT x.hid, x.d, sqrt(sum((x.c1 + x.c2) * (x.c1 + x.c2))::DOUBLE) AS px, sqrt(sum((x.c1 - x.c2) * (x.c1 - x.c2))::DOUBLE) AS mx,
        sum((x.c1 + x.c2) * (coalesce(e.c1, 0) + coalesce(e.c2, 0)))::DOUBLE AS pxe,
        sum((x.c1 - x.c2) * (coalesce(e.c1, 0) - coalesce(e.c2, 0)))::DOUBLE AS mxe
      FROM x LEFT JOIN e ON e.d = x.d AND e.b = x.b GROUP BY x.hid, x.d),
lanes AS (SELECT l0.*, n.pe, n.me FROM l0 JOIN n ON n.d = l0.d)"""
)


def _pair_bound(out: str, bound: str, geq: bool) -> str:
    """CTE ``out``: (hid, d, zx, ze) for one bound."""
    xi, psi, dot, other = ("pe", "me", "pxe", "mx") if geq else ("me", "pe", "mxe", "px")
    t = f"4 * {bound}" if geq else f"-4 * {bound}"
    return (
        f"""{out}_x AS (SELECT hid * 100 + d AS id, {xi} AS xi, {psi} AS psi, {t} AS t, {dot} / {xi} AS x, {other} AS y FROM lanes, bb),
{out}_e AS (SELECT hid * 100 + d AS id, {xi} AS xi, {psi} AS psi, {t} AS t, {xi} AS x, {psi} AS y FROM lanes, bb),
"""
        + _bilinear_sql(f"{out}_x", f"{out}_zx")
        + ",\n"
        + _bilinear_sql(f"{out}_e", f"{out}_ze")
        + f""",
{out} AS (SELECT l.hid, l.d, a.zeta * sqrt(0.5) AS zx, b.zeta * sqrt(0.5) AS ze
      FROM lanes l JOIN {out}_zx a ON a.id = l.hid * 100 + l.d JOIN {out}_ze b ON b.id = l.hid * 100 + l.d)"""
    )


def _pair_setup(spark, sf):
    li = lineitem_stream(spark, sf)

    def side_by_side(cells, by):
        one = lambda s: F.sum(F.when(F.col("sid") == s, F.col("c")).otherwise(F.lit(0).cast("bigint")))
        return cells.groupBy(*by, "d", "b").agg(one(0).alias("c1"), one(1).alias("c2"))

    cells = _cells(li, ["sid"])
    anchor = side_by_side(cells.where("not late"), [])
    drift = side_by_side(cells.where("late"), ["hid"])
    dots = sk.row_dots(anchor.select("d", "b", F.col("c1").alias("c")), anchor.select("d", "b", F.col("c2").alias("c")), PROJ)
    estimate = dots.agg(F.median("dot")).first()[0]
    low = estimate - (_BETA - _EPS) * abs(estimate) / (1 + _BETA)
    high = estimate + (_BETA - _EPS) * abs(estimate) / (1 - _BETA)
    return gd.site_states(anchor, drift, SITES), anchor, low, high


@query(
    "guard_join",
    with_(
        LI,
        _PAIR_SQL,
        _pair_bound("gl", "low", True),
        _pair_bound("gh", "high", False),
        _exact("gl", "zl"),
        _exact("gh", "zh"),
        "SELECT zl.hid, round(least(zl.zeta, zh.zeta), 4) AS zeta FROM zl JOIN zh ON zh.hid = zl.hid",
    ),
)
def guard_join(spark, sf):
    sites, anchor, low, high = _pair_setup(spark, sf)
    lanes = gd.polarised_lanes(sites, anchor, PROJ, ["hid"])
    return _rounded(gd.guard_join(lanes, low, high, PROJ, ["hid"]), ["hid"])


@query(
    "guard_inner_product",
    with_(
        LI,
        _PAIR_SQL,
        """w AS (SELECT hid, sqrt(sum(mx * mx)) AS mx, sum(pxe) AS pxe, sqrt(sum(pe * pe)) AS pe, sqrt(sum(me * me)) AS me
              FROM lanes GROUP BY hid)""",
        f"g AS (SELECT hid AS id, pe AS xi, me AS psi, 4 * {PROJ.depth} * low AS t, pxe / pe AS x, mx AS y FROM w, bb)",
        _bilinear_sql("g", "z"),
        "SELECT CAST(id AS INTEGER) AS hid, round(zeta * sqrt(0.5), 4) AS zeta FROM z",
    ),
)
def guard_inner_product(spark, sf):
    """Both operands' whole sketches as plain vectors, whose product must stay above D times the lower bound."""
    sites, anchor, low, _ = _pair_setup(spark, sf)
    return _rounded(gd.guard_inner_product(sites, anchor, PROJ, PROJ.depth * low, ["hid"]), ["hid"])
