"""Metadata, counts, frequency vectors, norms and order statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyflow.functions import scalars
from tallyflow.operators import frequency as fq
from tallyflow.operators import vectors
from tallyflow.operators.windows import time_window
from tallyflow.plans.catalog.base import DAY, EV, LI, query, with_
from tallyflow.sources.views import events_stream, lineitem_stream, table

_META_SQL = """CAST(count(*) AS BIGINT) AS size, min(ts) AS ts_min, max(ts) AS ts_max, min(key) AS key_min,
 max(key) AS key_max, array_to_string(list_sort(list(DISTINCT sid)), ',') AS stream_ids,
 array_to_string(list_sort(list(DISTINCT hid)), ',') AS source_ids"""


def _printable(meta):
    return meta.withColumns({c: F.array_join(c, ",") for c in ("stream_ids", "source_ids")})


@query(
    "analyze",
    with_(
        EV,
        f"""SELECT 'ev' AS name, {_META_SQL}, CAST(0 AS BIGINT) AS "window", CAST(0 AS BIGINT) AS warmup,
        max(ts) - min(ts) + 1 AS duration FROM ev""",
    ),
)
def analyze(spark, sf):
    return _printable(fq.analyze(events_stream(spark, sf), "ev")).withColumn("duration", fq.duration())


@query(
    "merge_metadata",
    with_(
        EV,
        LI,
        "u AS (SELECT sid, hid, key, ts FROM ev UNION ALL SELECT sid, hid, key, ts FROM li)",
        f"""SELECT 'merged' AS name, {_META_SQL}, CAST(0 AS BIGINT) AS "window", CAST(0 AS BIGINT) AS warmup FROM u""",
    ),
)
def merge_metadata(spark, sf):
    parts = fq.analyze(events_stream(spark, sf), "ev").unionByName(fq.analyze(lineitem_stream(spark, sf), "li"))
    return _printable(fq.merge_metadata(parts))


@query(
    "local_stream_matrix",
    with_(
        EV,
        """SELECT s.sid, h.hid, CAST(coalesce(n, 0) AS BIGINT) AS stream_len
        FROM (SELECT DISTINCT sid FROM ev) s CROSS JOIN (SELECT DISTINCT hid FROM ev) h
        LEFT JOIN (SELECT sid, hid, count(*) AS n FROM ev GROUP BY sid, hid) c ON c.sid = s.sid AND c.hid = h.hid""",
    ),
)
def local_stream_matrix(spark, sf):
    return fq.local_stream_matrix(events_stream(spark, sf))


@query(
    "stream_totals",
    with_(LI, "SELECT sid, CAST(count(*) AS BIGINT) AS records, CAST(count(DISTINCT hid) AS BIGINT) AS hosts FROM li GROUP BY sid"),
)
def stream_totals(spark, sf):
    return fq.stream_totals(lineitem_stream(spark, sf))


@query(
    "active_series",
    with_(
        EV,
        f"""w AS (SELECT sid, hid, key, upd, ts, seq, 0 AS kind FROM ev UNION ALL
              SELECT sid, hid, key, -upd, ts + {DAY}, seq, 1 FROM ev WHERE ts + {DAY} < (SELECT max(ts) FROM ev))""",
        """SELECT ts, kind, seq, sid, hid,
         CAST(sum(upd) OVER (PARTITION BY sid, hid ORDER BY ts, kind, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS local_active,
         CAST(sum(upd) OVER (PARTITION BY sid ORDER BY ts, kind, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stream_active,
         CAST(sum(upd) OVER (PARTITION BY hid ORDER BY ts, kind, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS host_active
        FROM w""",
    ),
)
def active_series(spark, sf):
    out = fq.active_series(time_window(events_stream(spark, sf), DAY))
    return out.select("ts", "kind", "seq", "sid", "hid", "local_active", "stream_active", "host_active")


@query("frequency_vector", with_(LI, "SELECT sid, key, CAST(sum(upd) AS BIGINT) AS cnt FROM li GROUP BY sid, key"))
def frequency_vector(spark, sf):
    return fq.frequency_vector(lineitem_stream(spark, sf))


@query(
    "pack",
    with_(
        LI,
        """SELECT key, CAST(sum(CASE sid WHEN 0 THEN upd ELSE -upd END) AS BIGINT) AS cnt FROM li GROUP BY key
        HAVING sum(CASE sid WHEN 0 THEN upd ELSE -upd END) <> 0""",
    ),
)
def pack(spark, sf):
    signed = lineitem_stream(spark, sf).withColumn("upd", F.when(F.col("sid") == 0, F.col("upd")).otherwise(-F.col("upd")))
    return fq.pack(fq.frequency_vector(signed, []))


@query(
    "pointwise_map",
    with_(LI, "SELECT sid, key, CAST(sum(upd) * sum(upd) + key % 3 AS BIGINT) AS cnt FROM li GROUP BY sid, key"),
)
def pointwise_map(spark, sf):
    freq = fq.frequency_vector(lineitem_stream(spark, sf))
    return fq.pointwise_map(freq, lambda key, cnt: cnt * cnt + key % 3)


@query(
    "pointwise_combine",
    with_(
        LI,
        """SELECT key, CAST(3 * sum(CASE sid WHEN 0 THEN upd ELSE 0 END) - sum(CASE sid WHEN 1 THEN upd ELSE 0 END) AS BIGINT) AS cnt
        FROM li GROUP BY key""",
    ),
)
def pointwise_combine(spark, sf):
    freq = fq.frequency_vector(lineitem_stream(spark, sf))
    side = lambda s: freq.where(F.col("sid") == s)
    return fq.pointwise_combine(side(0), side(1), lambda x, y: 3 * x - y)


_TWO = """f AS (SELECT sid, key, sum(upd) AS cnt FROM li GROUP BY sid, key),
p AS (SELECT coalesce(a.key, b.key) AS key, coalesce(a.cnt, 0) AS x, coalesce(b.cnt, 0) AS y
      FROM (SELECT * FROM f WHERE sid = 0) a FULL JOIN (SELECT * FROM f WHERE sid = 1) b ON a.key = b.key)"""


@query("inner_product", with_(LI, _TWO, "SELECT CAST(sum(x * y) AS DOUBLE) AS product FROM p"))
def inner_product(spark, sf):
    freq = fq.frequency_vector(lineitem_stream(spark, sf))
    return fq.inner_product(freq.where("sid = 0"), freq.where("sid = 1"))


@query(
    "cosine_similarity",
    with_(LI, _TWO, "SELECT round(sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))), 9) AS cosine FROM p"),
)
def cosine_similarity(spark, sf):
    freq = fq.frequency_vector(lineitem_stream(spark, sf))
    out = fq.cosine_similarity(freq.where("sid = 0"), freq.where("sid = 1"))
    return out.select(F.round("cosine", 9).alias("cosine"))


@query(
    "norms",
    with_(
        LI,
        "f AS (SELECT sid, key, sum(upd) AS cnt FROM li GROUP BY sid, key)",
        """SELECT sid, CAST(sum(abs(cnt)) AS BIGINT) AS l1, round(sqrt(sum(cnt * cnt)), 6) AS l2,
        CAST(max(abs(cnt)) AS BIGINT) AS linf FROM f GROUP BY sid""",
    ),
)
def norms(spark, sf):
    out = fq.norms(fq.frequency_vector(lineitem_stream(spark, sf)), ["sid"])
    return out.withColumn("l2", F.round("l2", 6))


@query(
    "dot",
    """WITH x AS (SELECT vec_id, unnest(embedding) AS v FROM embeddings)
    SELECT vec_id, round(sum(CAST(v AS DOUBLE) * CAST(v AS DOUBLE)), 6) AS dot,
     round(sum(abs(CAST(v AS DOUBLE))), 6) AS l1, round(max(abs(CAST(v AS DOUBLE))), 6) AS linf
    FROM x GROUP BY vec_id""",
)
def dot(spark, sf):
    e = F.col("embedding")
    n = fq.dense_norms(e)
    return table(spark, sf, "embeddings").select(
        "vec_id",
        F.round(fq.dense_dot(e, e), 6).alias("dot"),
        F.round(n["l1"], 6).alias("l1"),
        F.round(n["linf"], 6).alias("linf"),
    )


_CENTROID = """x AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS v FROM embeddings),
m AS (SELECT i, avg(CAST(v AS DOUBLE)) AS v FROM x GROUP BY i)"""


@query(
    "dot_pair",
    with_(
        _CENTROID,
        """SELECT vec_id, round(sum(CAST(x.v AS DOUBLE) * m.v), 6) AS dot FROM x JOIN m USING (i) GROUP BY vec_id""",
    ),
)
def dot_pair(spark, sf):
    """Each embedding against the mean one, in long form."""
    long = _long_embeddings(spark, sf)
    mean = long.groupBy("i").agg(F.avg("v").alias("m"))
    joined = long.join(F.broadcast(mean), "i")  # one row per dimension
    return joined.groupBy("vec_id").agg(F.round(F.sum(F.col("v") * F.col("m")), 6).alias("dot"))


def _long_embeddings(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "v"))
    return e.select("vec_id", "label", F.col("i").cast("int").alias("i"), F.col("v").cast("double").alias("v"))


@query(
    "order_select",
    with_(
        """r AS (SELECT l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS n FROM lineitem)""",
        "SELECT l_suppkey, l_quantity FROM r WHERE n = 8",
    ),
)
def order_select(spark, sf):
    return fq.order_select(table(spark, sf, "lineitem"), "l_quantity", 7, ["l_suppkey"])


@query(
    "median",
    "SELECT l_suppkey, median(l_extendedprice) AS median FROM lineitem GROUP BY l_suppkey",
)
def median(spark, sf):
    return fq.median(table(spark, sf, "lineitem"), "l_extendedprice", ["l_suppkey"])


@query(
    "scalar_math",
    with_(
        LI,
        """f AS (SELECT key, sum(CASE sid WHEN 0 THEN upd ELSE -upd END) AS z FROM li GROUP BY key)""",
        "SELECT key, CAST(z * z AS BIGINT) AS sq, CAST(z * z * z AS BIGINT) AS cb, CAST(sign(z) AS INTEGER) AS sgn FROM f",
    ),
)
def scalar_math(spark, sf):
    z = F.sum(F.when(F.col("sid") == 0, F.col("upd")).otherwise(-F.col("upd")))
    f = lineitem_stream(spark, sf).groupBy("key").agg(z.alias("z"))
    c = F.col("z")
    return f.select("key", scalars.square(c).alias("sq"), scalars.cube(c).alias("cb"), scalars.sign(c).alias("sgn"))


# A sparse change of long-form vectors: every third dimension is raised by one tenth of its place.
_DELTA_SQL = """x AS (SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS i,
                CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
dl AS (SELECT vec_id, i, v AS old, v + i / 10.0 AS new FROM x WHERE i % 3 = 0),
d2 AS (SELECT vec_id, i, v AS old, v * 2 AS new FROM x WHERE i % 4 = 0)"""


def _delta(long):
    return long.where("i % 3 = 0").select(
        "vec_id", "i", F.col("v").alias("old"), (F.col("v") + F.col("i") / F.lit(10.0)).alias("new")
    )


def _doubling(long):
    return long.where("i % 4 = 0").select("vec_id", "i", F.col("v").alias("old"), (F.col("v") * 2).alias("new"))


@query(
    "delta_apply",
    with_(
        _DELTA_SQL,
        """SELECT x.vec_id, x.i, round(coalesce(dl.new, x.v), 6) AS v
        FROM x LEFT JOIN dl ON dl.vec_id = x.vec_id AND dl.i = x.i""",
    ),
)
def delta_apply(spark, sf):
    long = _long_embeddings(spark, sf).drop("label")
    return vectors.apply_delta(long, _delta(long), ["vec_id"]).withColumn("v", F.round("v", 6))


@query(
    "delta_combine",
    with_(
        _DELTA_SQL,
        """SELECT coalesce(dl.vec_id, d2.vec_id) AS vec_id, coalesce(dl.i, d2.i) AS i,
         round(coalesce(dl.old, 0) * coalesce(d2.old, 0), 6) AS old,
         round(coalesce(dl.new, 0) * coalesce(d2.new, 0), 6) AS new
        FROM dl FULL JOIN d2 ON dl.vec_id = d2.vec_id AND dl.i = d2.i""",
    ),
)
def delta_combine(spark, sf):
    long = _long_embeddings(spark, sf).drop("label")
    out = vectors.combine_deltas(_delta(long), _doubling(long), lambda a, b: a * b, ["vec_id"])
    return out.withColumns({c: F.round(c, 6) for c in ("old", "new")})


@query(
    "delta_rebase",
    with_(
        _DELTA_SQL,
        "y AS (SELECT vec_id, i, v + 1 AS v FROM x)",
        """SELECT dl.vec_id, dl.i, round(y.v, 6) AS old, round(y.v + (dl.new - dl.old), 6) AS new
        FROM dl JOIN y ON dl.vec_id = y.vec_id AND dl.i = y.i WHERE dl.i < 24""",
    ),
)
def delta_rebase(spark, sf):
    """Masked and moved onto a shifted vector."""
    long = _long_embeddings(spark, sf).drop("label")
    shifted = long.withColumn("v", F.col("v") + 1)
    out = vectors.rebase_delta(shifted, vectors.mask_delta(_delta(long), F.col("i") < 24), ["vec_id"])
    return out.withColumns({c: F.round(c, 6) for c in ("old", "new")})


@query(
    "incremental_dot",
    with_(
        _DELTA_SQL,
        "n AS (SELECT x.vec_id, x.i, x.v AS y, coalesce(dl.new, x.v) AS z FROM x LEFT JOIN dl ON dl.vec_id = x.vec_id AND dl.i = x.i)",
        """SELECT vec_id, round(sum(z * y), 6) AS dot, round(sqrt(sum(z * z)), 6) AS norm FROM n GROUP BY vec_id""",
    ),
)
def incremental_dot(spark, sf):
    """Dot product with the old vector and norm after the change, from the change alone."""
    long = _long_embeddings(spark, sf).drop("label")
    delta = _delta(long)
    start = long.groupBy("vec_id").agg(F.sum(F.col("v") * F.col("v")).alias("s"))
    moved = vectors.dot_change(delta, long, ["vec_id"]).withColumnRenamed("change", "a")
    grown = vectors.square_change(delta, ["vec_id"]).withColumnRenamed("change", "b")
    out = start.join(moved, "vec_id").join(grown, "vec_id")
    return out.select(
        "vec_id", F.round(F.col("s") + F.col("a"), 6).alias("dot"), F.round(F.sqrt(F.col("s") + F.col("b")), 6).alias("norm")
    )
