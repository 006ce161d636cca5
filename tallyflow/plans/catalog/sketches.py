"""AGMS sketches: building, algebra, estimates, sizing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyflow.functions import bounds
from tallyflow.operators import grids
from tallyflow.operators import sketch as sk
from tallyflow.operators.frequency import frequency_vector
from tallyflow.operators.windows import time_window
from tallyflow.plans.catalog.base import (
    DAY,
    EV,
    LI,
    PROJ,
    hashed_cte,
    query,
    seeds_cte,
    sketch_cte,
    uniform_int_sql,
    with_,
)
from tallyflow.sources.generators import trial_counts
from tallyflow.sources.views import events_stream, lineitem_stream, table

_SK = sketch_cte("li", "sk")


def _li_sketch(spark, sf):
    return sk.sketch(lineitem_stream(spark, sf), PROJ)


def _side(cells, s):
    return cells.where(F.col("sid") == s).drop("sid")


@query("hash_family", with_(LI, seeds_cte(), "k AS (SELECT DISTINCT key FROM li)", hashed_cte("k", "h"),
                            "SELECT key, d, b, CAST(sg AS BIGINT) AS sign FROM h"))
def hash_family(spark, sf):
    return sk.hashed(lineitem_stream(spark, sf).select("key").distinct(), PROJ)


_SUM = sk.Projection(PROJ.depth, PROJ.width, PROJ.seed, family="sum")


@query("hash_family_sum", with_(LI, seeds_cte(_SUM), "k AS (SELECT DISTINCT key FROM li)", hashed_cte("k", "h", _SUM),
                                "SELECT key, d, b, CAST(sg AS BIGINT) AS sign FROM h"))
def hash_family_sum(spark, sf):
    """The family that folds by sum and takes the low bit as sign."""
    return sk.hashed(lineitem_stream(spark, sf).select("key").distinct(), _SUM)


@query("sketch_build", with_(LI, seeds_cte(), _SK, "SELECT sid, d, b, c FROM sk"))
def sketch_build(spark, sf):
    return _li_sketch(spark, sf)


@query(
    "sketch_update",
    with_(
        EV,
        seeds_cte(),
        f"""w AS (SELECT sid, key, upd FROM ev UNION ALL SELECT sid, key, -upd FROM ev
                  WHERE ts + {DAY} < (SELECT max(ts) FROM ev))""",
        sketch_cte("w", "sk"),
        "SELECT sid, d, b, c FROM sk WHERE c <> 0",
    ),
)
def sketch_update(spark, sf):
    """Inserts and erasures of a one-day window."""
    return sk.sketch(time_window(events_stream(spark, sf), DAY), PROJ).where("c <> 0")


@query("sketch_add", with_(LI, seeds_cte(), sketch_cte("li", "sk", "hid"),
                           "SELECT d, b, CAST(sum(c) AS BIGINT) AS c FROM sk GROUP BY d, b"))
def sketch_add(spark, sf):
    """Sketches of all hosts merged."""
    return sk.merge(sk.sketch(lineitem_stream(spark, sf), PROJ, ["hid"]), ["hid"])


@query("sketch_sub", with_(LI, seeds_cte(), _SK,
                           "SELECT d, b, CAST(sum(CASE sid WHEN 0 THEN c ELSE -c END) AS BIGINT) AS c FROM sk GROUP BY d, b"))
def sketch_sub(spark, sf):
    cells = _li_sketch(spark, sf)
    return sk.subtract(_side(cells, 0), _side(cells, 1))


@query("sketch_scale", with_(LI, seeds_cte(), _SK, "SELECT sid, d, b, c * 3 / 2.0 AS c FROM sk"))
def sketch_scale(spark, sf):
    return sk.divide(sk.scale(_li_sketch(spark, sf), 3), 2.0)


@query("sketch_blend", with_(LI, seeds_cte(), _SK,
                             "SELECT d, b, sum(CASE sid WHEN 0 THEN c * 0.75 ELSE c * 0.25 END)::DOUBLE AS c FROM sk GROUP BY d, b"))
def sketch_blend(spark, sf):
    cells = _li_sketch(spark, sf)
    return sk.blend(_side(cells, 0), _side(cells, 1), 0.25)


@query(
    "sketch_equal",
    with_(
        LI,
        seeds_cte(),
        _SK,
        """SELECT CAST(count(*) FILTER (WHERE z <> 0) AS BIGINT) AS differing FROM
        (SELECT d, b, sum(CASE sid WHEN 0 THEN c ELSE -c END) AS z FROM sk GROUP BY d, b) t""",
    ),
)
def sketch_equal(spark, sf):
    cells = _li_sketch(spark, sf)
    return sk.differing_cells(_side(cells, 0), _side(cells, 1))


_DOTS = """dots AS (SELECT a.d, CAST(sum(a.c * b.c) AS DOUBLE) AS dot FROM sk a JOIN sk b ON a.d = b.d AND a.b = b.b
         WHERE a.sid = 0 AND b.sid = 1 GROUP BY a.d)"""


@query("row_dots", with_(LI, seeds_cte(), _SK, _DOTS, "SELECT d, dot FROM dots"))
def row_dots(spark, sf):
    cells = _li_sketch(spark, sf)
    return sk.row_dots(_side(cells, 0), _side(cells, 1), PROJ)


@query(
    "selfjoin_sketch",
    with_(LI, seeds_cte(), _SK,
          "q AS (SELECT sid, d, CAST(sum(c * c) AS DOUBLE) AS r FROM sk GROUP BY sid, d)",
          "SELECT sid, median(r) AS estimate FROM q GROUP BY sid"),
)
def selfjoin_sketch(spark, sf):
    return sk.selfjoin_estimate(_li_sketch(spark, sf), PROJ)


@query("join_sketch", with_(LI, seeds_cte(), _SK, _DOTS, "SELECT median(dot) AS estimate FROM dots"))
def join_sketch(spark, sf):
    cells = _li_sketch(spark, sf)
    return sk.join_estimate(_side(cells, 0), _side(cells, 1), PROJ)


RUNNING_SELFJOIN_SQL = (
    seeds_cte()
    + ",\n"
    + hashed_cte("ev", "h")
    + """,
g AS (SELECT sid, ts, seq, d, sg * upd AS u, sum(sg * upd) OVER (PARTITION BY sid, d, b ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS c FROM h),
p AS (SELECT sid, ts, seq, d, CAST(sum(c * c - (c - u) * (c - u)) OVER (PARTITION BY sid, d ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS p FROM g),
e AS (SELECT sid, ts, seq, median(p) AS estimate FROM p GROUP BY sid, ts, seq)"""
)


@query("selfjoin_sketch_running", with_(EV, RUNNING_SELFJOIN_SQL, "SELECT sid, ts, seq, estimate FROM e"))
def selfjoin_sketch_running(spark, sf):
    return sk.selfjoin_estimate_running(events_stream(spark, sf), PROJ)


@query(
    "join_sketch_running",
    with_(
        EV,
        seeds_cte(),
        """w AS (SELECT key, ts, seq, CASE sid WHEN 0 THEN upd ELSE 0 END AS v1, CASE sid WHEN 4 THEN upd ELSE 0 END AS v2
              FROM ev WHERE sid IN (0, 4))""",
        hashed_cte("w", "h"),
        """g AS (SELECT ts, seq, d, sg * v1 AS u1, sg * v2 AS u2, sum(sg * v1) OVER k AS c1, sum(sg * v2) OVER k AS c2 FROM h
              WINDOW k AS (PARTITION BY d, b ORDER BY ts, seq ROWS UNBOUNDED PRECEDING))""",
        """p AS (SELECT ts, seq, d, CAST(sum(c1 * c2 - (c1 - u1) * (c2 - u2)) OVER (PARTITION BY d ORDER BY ts, seq
              ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS p FROM g)""",
        "SELECT ts, seq, median(p) AS estimate FROM p GROUP BY ts, seq",
    ),
)
def join_sketch_running(spark, sf):
    return sk.join_estimate_running(events_stream(spark, sf), 0, 4, PROJ)


@query(
    "point_estimate",
    with_(
        LI,
        seeds_cte(),
        _SK,
        "k AS (SELECT DISTINCT sid, key FROM li)",
        hashed_cte("k", "h"),
        """SELECT h.sid, h.key, median(CAST(h.sg * coalesce(sk.c, 0) AS DOUBLE)) AS estimate
        FROM h LEFT JOIN sk ON sk.sid = h.sid AND sk.d = h.d AND sk.b = h.b GROUP BY h.sid, h.key""",
    ),
)
def point_estimate(spark, sf):
    li = lineitem_stream(spark, sf)
    return sk.point_estimate(_li_sketch(spark, sf), li.select("sid", "key").distinct(), PROJ)


@query(
    "sketch_norm",
    with_(LI, seeds_cte(), _SK,
          "SELECT sid, CAST(sum(c * c) AS DOUBLE) AS norm2, round(sqrt(sum(c * c)), 6) AS norm FROM sk GROUP BY sid"),
)
def sketch_norm(spark, sf):
    return sk.sketch_norm(_li_sketch(spark, sf)).withColumn("norm", F.round("norm", 6))


# Grids of depth and width taken from the data: part sizes stand for widths.
_GRID = "g AS (SELECT DISTINCT CAST(p_size AS BIGINT) * 50 AS width, CAST(p_size % 9 + 1 AS BIGINT) AS depth FROM part)"


def _grid(spark, sf):
    size = F.col("p_size").cast("bigint")
    return table(spark, sf, "part").select((size * 50).alias("width"), (size % 9 + 1).alias("depth")).distinct()


@query(
    "sketch_bounds",
    with_(_GRID, "SELECT width, depth, round(4 / sqrt(width), 6) AS epsilon, round(pow(sqrt(0.5), depth), 6) AS failure FROM g"),
)
def sketch_bounds(spark, sf):
    eps, fail = bounds.sketch_epsilon(F.col("width")), bounds.failure_probability(F.col("depth"))
    return _grid(spark, sf).select("width", "depth", F.round(eps, 6).alias("epsilon"), F.round(fail, 6).alias("failure"))


@query(
    "sketch_sizing",
    with_(
        """b AS (SELECT DISTINCT (l_tax + 1) / 10 AS beta FROM lineitem)""",
        """g AS (SELECT DISTINCT CAST(s_suppkey % 27 + 2 AS BIGINT) AS sites FROM supplier)""",
        """SELECT round(beta, 6) AS beta, sites, CAST(ceil(2 * log2(2 * sites / 0.03)) AS BIGINT) AS depth,
         CAST(ceil(16 / ((beta / 2) * (beta / 2))) AS BIGINT) AS width,
         round(sqrt(1 + (beta / 2) / pow(1 + beta / 2, 2)) - 1, 6) AS theta,
         CAST(ceil(2 * ln(1 / 0.03)) AS BIGINT) AS guard_depth FROM b, g""",
    ),
)
def sketch_sizing(spark, sf):
    """Sizes for every (beta, sites) of a grid, with epsilon = beta / 2."""
    beta = table(spark, sf, "lineitem").select(((F.col("l_tax") + 1) / 10).alias("beta")).distinct()
    sites = table(spark, sf, "supplier").select((F.col("s_suppkey") % 27 + 2).alias("sites")).distinct()
    grid = grids.cross(beta, sites)
    eps, gamma = F.col("beta") / 2, F.lit(0.03)
    size = bounds.publish_sizing(F.col("beta"), gamma, F.col("sites"), eps)
    guard = bounds.guard_sizing(gamma, eps)
    return grid.select(
        F.round("beta", 6).alias("beta"),
        "sites",
        size["depth"].alias("depth"),
        size["width"].alias("width"),
        F.round(size["theta"], 6).alias("theta"),
        guard["depth"].alias("guard_depth"),
    )


ACCURACY_SQL = with_(
    EV,
    seeds_cte(),
    sketch_cte("ev", "sk"),
    "f AS (SELECT sid, key, sum(upd) AS cnt FROM ev GROUP BY sid, key)",
    "x AS (SELECT sid, CAST(sum(cnt * cnt) AS DOUBLE) AS exact FROM f GROUP BY sid)",
    "q AS (SELECT sid, d, CAST(sum(c * c) AS DOUBLE) AS r FROM sk GROUP BY sid, d)",
    "m AS (SELECT sid, median(r) AS estimate FROM q GROUP BY sid)",
    f"""SELECT x.sid, exact, estimate, abs((exact - estimate) / exact) AS rel_error,
     abs((exact - estimate) / exact) <= {PROJ.epsilon!r} AS within FROM x JOIN m ON m.sid = x.sid""",
)


@query("sketch_accuracy", ACCURACY_SQL)
def sketch_accuracy(spark, sf):
    return sk.accuracy(events_stream(spark, sf), PROJ)


#: The grid of sketch sizes and key ranges, and the trials of each setting.
_SWEEP_SIZES = tuple(sk.Projection(d, w, seed=5) for d in (3, 5, 7) for w in (500, 1000, 1500, 2000, 2500))
_SWEEP_KEYS = (1_000, 10_000, 100_000)
_SWEEP_TRIALS = 100
#: In how many of the trials a record takes part: streams of n / 100, n / 10 and n records.
_SWEEP_SHARES = (1, 10, 100)
_SWEEP_SEED = 11


def _sweep_sql() -> str:
    keys = ", ".join(f"({m})" for m in _SWEEP_KEYS)
    shares = ", ".join(f"({f})" for f in _SWEEP_SHARES)
    ctes = [
        f"""t AS (SELECT max_key, share, CAST((event_id + i * ({_SWEEP_TRIALS} // share)) % {_SWEEP_TRIALS} AS INTEGER) AS trial,
             ((event_id * 1000003 + max_key) * 101 + share) * {_SWEEP_TRIALS} + i AS id
           FROM events, (VALUES {keys}) m(max_key), (VALUES {shares}) l(share), range(0, {_SWEEP_TRIALS}) r(i) WHERE i < share)""",
        f"""f AS (SELECT max_key, share, trial, {uniform_int_sql('id', 'max_key', _SWEEP_SEED, 'key')} AS key, count(*) AS upd
             FROM t GROUP BY 1, 2, 3, 4)""",
        "x AS (SELECT max_key, share, trial, CAST(sum(upd) AS BIGINT) AS n, sum(upd * upd)::DOUBLE AS exact FROM f GROUP BY 1, 2, 3)",
    ]
    rows = []
    for n, proj in enumerate(_SWEEP_SIZES):
        ctes += [
            seeds_cte(proj, f"seeds{n}"),
            sketch_cte("f", f"s{n}", "max_key, share, trial", proj, f"seeds{n}"),
            f"q{n} AS (SELECT max_key, share, trial, d, sum(c * c)::DOUBLE AS r FROM s{n} GROUP BY 1, 2, 3, 4)",
            f"m{n} AS (SELECT max_key, share, trial, median(r) AS estimate FROM q{n} GROUP BY 1, 2, 3)",
        ]
        rows.append(
            f"""SELECT {proj.depth} AS depth, {proj.width} AS width, x.max_key, x.share, CAST(count(*) AS BIGINT) AS trials, CAST(max(n) AS BIGINT) AS length,
            avg(CASE WHEN abs(estimate / exact - 1) > {proj.epsilon / 3!r} THEN 1.0 ELSE 0.0 END) AS failure_rate,
            CAST({proj.failure_probability!r} AS DOUBLE) AS bound FROM m{n} JOIN x USING (max_key, share, trial) GROUP BY x.max_key, x.share"""
        )
    return with_(*ctes, " UNION ALL ".join(rows))


@query("accuracy_sweep", _sweep_sql())
def accuracy_sweep(spark, sf):
    """Failure rate of the estimate over trials, sketch sizes, key ranges and lengths, against its bound.

    A trial is a uniform stream with keys of its own.  Every record of ``events`` takes part in 1, 10
    or all of the 100 trials of a setting, so lengths are n / 100, n / 10 and n.  Tasks count the
    keys of all settings and trials; the counts are shuffled once by trial and hashed there for all sizes.
    """
    ids = table(spark, sf, "events").select(F.col("event_id").alias("id"))
    counts = trial_counts(ids, _SWEEP_KEYS, _SWEEP_SHARES, _SWEEP_TRIALS, _SWEEP_SEED)
    found = sk.selfjoin_estimates(counts, _SWEEP_SIZES, ["max_key", "share", "trial"])
    size = F.concat_ws("x", "depth", "width")
    limits = {f"{p.depth}x{p.width}": (p.epsilon / 3, p.failure_probability) for p in _SWEEP_SIZES}
    epsilon, bound = (F.create_map(*[F.lit(v) for k, x in limits.items() for v in (k, x[i])])[size] for i in (0, 1))
    error = F.abs(F.col("estimate") / F.col("exact") - 1)
    return found.groupBy("depth", "width", "max_key", "share").agg(
        F.count(F.lit(1)).alias("trials"),
        F.max("n").alias("length"),
        F.avg(F.when(error > epsilon, 1.0).otherwise(0.0)).alias("failure_rate"),
        F.first(bound).alias("bound"),
    )


@query(
    "sketch_udaf",
    with_(
        EV,
        seeds_cte(),
        sketch_cte("ev", "sk", "sid, hid"),
        "SELECT sid, hid, d, b, c FROM sk WHERE c <> 0",
    ),
)
def sketch_udaf(spark, sf):
    """The sketch as an aggregate function over runs of at most 100,000 records, then merged."""
    ev = events_stream(spark, sf).withColumn("part", F.expr("seq div 100000L"))
    flat = ev.groupBy("sid", "hid", "part").agg(sk.agms_udaf(PROJ)("key", "upd").alias("v"))
    cells = flat.select("sid", "hid", F.posexplode("v").alias("i", "c")).where("c <> 0")
    cells = cells.select(
        "sid", "hid", F.expr(f"i div {PROJ.width}").cast("int").alias("d"), (F.col("i") % PROJ.width).cast("int").alias("b"), "c"
    )
    merged = cells.groupBy("sid", "hid", "d", "b").agg(F.sum("c").alias("c"))
    return merged.where("c <> 0")


