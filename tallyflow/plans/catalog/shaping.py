"""Transforms, cuts, windows, merges, predicates and parameter grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyflow.functions import predicates as pr
from tallyflow.functions.scalars import relative_error
from tallyflow.operators import grids, merging, results
from tallyflow.operators import transforms as tr
from tallyflow.operators import windows as wn
from tallyflow.plans.catalog.base import DAY, EV, query, with_
from tallyflow.sources.views import event_updates, events_stream, table
from tallyflow.streaming.feeds import drain_to_table, stream_files
from tallyflow.streaming.windows import window_counts

_COLS = "sid, hid, key, upd, ts, seq"


@query("max_length", with_(EV, f"SELECT {_COLS} FROM ev ORDER BY ts, seq LIMIT 1234"))
def max_length(spark, sf):
    return tr.max_length(events_stream(spark, sf), 1234)


@query("max_timestamp", with_(EV, f"SELECT {_COLS} FROM ev WHERE ts <= 1705000000"))
def max_timestamp(spark, sf):
    return tr.max_timestamp(events_stream(spark, sf), 1705000000)


@query("hash_streams", with_(EV, "SELECT CAST(sid % 2 AS INTEGER) AS sid, hid, key, upd, ts, seq FROM ev"))
def hash_streams(spark, sf):
    return tr.hash_streams(events_stream(spark, sf), 2)


@query("hash_sources", with_(EV, "SELECT sid, CAST(hid % 3 AS INTEGER) AS hid, key, upd, ts, seq FROM ev"))
def hash_sources(spark, sf):
    return tr.hash_sources(events_stream(spark, sf), 3)


@query("negate", with_(EV, "SELECT sid, hid, key, -upd AS upd, ts, seq FROM ev"))
def negate(spark, sf):
    return tr.negate(events_stream(spark, sf))


@query("time_shift", with_(EV, "SELECT sid, hid, key, upd, ts - 1000 AS ts, seq FROM ev"))
def time_shift(spark, sf):
    return tr.time_shift(events_stream(spark, sf), -1000)


_LOOP = """x AS (SELECT max(ts) - min(ts) + 1 AS span, max(seq) - min(seq) + 1 AS ids FROM ev),
lp AS (SELECT sid, hid, key, upd, ts + i * span AS ts, seq + i * ids AS seq FROM ev, x, range(3) r(i))"""


@query("loop_replay", with_(EV, _LOOP, f"SELECT {_COLS} FROM lp"))
def loop_replay(spark, sf):
    return tr.loop_replay(events_stream(spark, sf), 3)


@query(
    "time_slice",
    with_(
        EV,
        "r AS (SELECT *, row_number() OVER (ORDER BY ts, seq) - 1 AS pos FROM ev)",
        f"SELECT {_COLS} FROM r WHERE ts >= 1704500000 AND ts < 1705500000 AND pos >= 100 AND pos < 9000",
    ),
)
def time_slice(spark, sf):
    """A slice by position, then by time."""
    return tr.time_slice(tr.position_slice(events_stream(spark, sf), 100, 9000), 1704500000, 1705500000)


@query(
    "time_index",
    with_(EV, """SELECT t AS ts, CAST(count(*) FILTER (WHERE ev.ts < t) AS BIGINT) AS pos
    FROM ev, (VALUES (CAST(1704067200 AS BIGINT)), (1705000000), (1706000000)) v(t) GROUP BY t"""),
)
def time_index(spark, sf):
    return tr.time_index(events_stream(spark, sf), 1704067200, 1705000000, 1706000000)


@query(
    "is_sorted",
    with_(
        "o AS (SELECT o_orderkey AS seq, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS ts FROM orders)",
        "l AS (SELECT ts, lag(ts) OVER (ORDER BY seq) AS before FROM o)",
        "SELECT CAST(count(*) FILTER (WHERE ts < before) AS BIGINT) AS violations FROM l",
    ),
)
def is_sorted(spark, sf):
    """How often an order is older than the one with the preceding key."""
    orders = table(spark, sf, "orders")
    stream = orders.select(F.unix_timestamp(F.col("o_orderdate")).alias("ts"), F.col("o_orderkey").alias("seq"))
    return tr.order_violations(stream)


@query("warmup_split", with_(EV, f"SELECT {_COLS}, ts < (SELECT min(ts) FROM ev) + {5 * DAY} AS warmup FROM ev"))
def warmup_split(spark, sf):
    return tr.warmup_split(events_stream(spark, sf), time=5 * DAY)


@query(
    "warmup_split_size",
    with_(EV, f"SELECT {_COLS}, row_number() OVER (ORDER BY ts, seq) <= 500 AS warmup FROM ev"),
)
def warmup_split_size(spark, sf):
    return tr.warmup_split(events_stream(spark, sf), size=500)


@query(
    "prepare",
    with_(
        EV,
        _LOOP.replace("range(3)", "range(2)"),
        "c AS (SELECT * FROM lp ORDER BY ts, seq LIMIT 8000)",
        "h AS (SELECT CAST(sid % 2 AS INTEGER) AS sid, CAST(hid % 4 AS INTEGER) AS hid, key, upd, ts, seq FROM c WHERE ts <= 1707000000)",
        f"""w AS (SELECT *, 0 AS kind FROM h UNION ALL SELECT sid, hid, key, -upd, ts + {DAY}, seq, 1 FROM h
              WHERE ts + {DAY} < (SELECT max(ts) FROM h))""",
        f"SELECT {_COLS}, kind, ts < (SELECT min(ts) FROM w) + {2 * DAY} AS warmup FROM w",
    ),
)
def prepare(spark, sf):
    options = tr.Preparation(
        loops=2, max_length=8000, max_timestamp=1707000000, hash_streams=2, hash_sources=4, time_window=DAY, warmup_time=2 * DAY
    )
    return tr.prepare(events_stream(spark, sf), options)


@query("record_map", with_(EV, "SELECT sid, hid, key * 2 + sid AS key, upd, ts, seq FROM ev WHERE key <> 13"))
def record_map(spark, sf):
    edit = lambda s: s.where("key <> 13").withColumn("key", F.col("key") * 2 + F.col("sid"))
    return tr.record_map(events_stream(spark, sf), edit)


@query(
    "record_map_end",
    with_(
        EV,
        "stop AS (SELECT min(seq) AS seq FROM ev WHERE key = 99 AND sid = 4 AND hid = 7)",
        "SELECT sid, hid, -key AS key, upd, ts, seq FROM ev WHERE seq < coalesce((SELECT seq FROM stop), 9223372036854775807)",
    ),
)
def record_map_end(spark, sf):
    """A record function that ends the stream at a certain record."""
    ends = lambda s: (F.col("key") == 99) & (F.col("sid") == 4) & (F.col("hid") == 7)
    return tr.record_map(events_stream(spark, sf), lambda s: s.withColumn("key", -F.col("key")), ends)


# -- windows --------------------------------------------------------------------


def _tw(flush: bool) -> str:
    cut = "" if flush else f" WHERE ts + {DAY} < (SELECT max(ts) FROM ev)"
    return f"SELECT {_COLS}, 0 AS kind FROM ev UNION ALL SELECT sid, hid, key, -upd, ts + {DAY}, seq, 1 FROM ev{cut}"


@query("time_window", with_(EV, _tw(False)))
def time_window(spark, sf):
    return wn.time_window(events_stream(spark, sf), DAY)


@query("time_window_flush", with_(EV, _tw(True)))
def time_window_flush(spark, sf):
    return wn.time_window(events_stream(spark, sf), DAY, flush=True)


def _cw(flush: bool) -> str:
    end = "coalesce(e, (SELECT max(ts) FROM ev))" if flush else "e"
    cut = "" if flush else " WHERE i + 300 < (SELECT count(*) FROM ev)"
    return f"""SELECT sid, hid, key, upd, ts, 2 * i AS seq FROM p UNION ALL
    SELECT sid, hid, key, -upd, {end}, 2 * (i + 299) + 1 FROM p{cut}"""


_CP = "p AS (SELECT *, row_number() OVER (ORDER BY ts, seq) - 1 AS i, lead(ts, 299) OVER (ORDER BY ts, seq) AS e FROM ev)"


@query("count_window", with_(EV, _CP, _cw(False)))
def count_window(spark, sf):
    return wn.count_window(events_stream(spark, sf), 300)


@query("count_window_flush", with_(EV, _CP, _cw(True)))
def count_window_flush(spark, sf):
    return wn.count_window(events_stream(spark, sf), 300, flush=True)


_SITE_WINDOW = f"""w AS ({_tw(True)}),
z AS (SELECT *, CAST(sum(upd) OVER (PARTITION BY sid, hid ORDER BY ts, kind, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS wsize,
      lead(ts) OVER (PARTITION BY sid, hid ORDER BY ts, kind, seq) - ts AS held FROM w)"""


@query("site_time_window", with_(EV, _SITE_WINDOW, f"SELECT {_COLS}, kind, wsize FROM z"))
def site_time_window(spark, sf):
    return wn.site_time_window(events_stream(spark, sf), DAY)


@query(
    "site_window_load",
    with_(
        EV,
        _SITE_WINDOW,
        """SELECT sid, hid, max(wsize) AS max_size, round(CAST(sum(wsize * held) AS DOUBLE) / (max(ts) - min(ts)), 6) AS avg_size
        FROM z GROUP BY sid, hid""",
    ),
)
def site_window_load(spark, sf):
    out = wn.window_load(wn.time_window(events_stream(spark, sf), DAY, flush=True))
    return out.withColumn("avg_size", F.round("avg_size", 6))


_SITE_COUNT = """p AS (SELECT *, lead(ts, 5) OVER k AS e, lead(seq, 5) OVER k AS s FROM ev WINDOW k AS (PARTITION BY sid, hid ORDER BY ts, seq))"""


@query(
    "site_count_window",
    with_(
        EV,
        _SITE_COUNT,
        f"SELECT {_COLS}, 0 AS slot FROM ev UNION ALL SELECT sid, hid, key, -upd, e, s, -1 FROM p WHERE e IS NOT NULL",
    ),
)
def site_count_window(spark, sf):
    return wn.site_count_window(events_stream(spark, sf), 5)


@query(
    "site_eviction_gaps",
    with_(
        EV,
        _SITE_COUNT,
        """SELECT * FROM (SELECT sid, hid, e AS ts, s AS seq, e - lag(e) OVER (PARTITION BY sid, hid ORDER BY e, s) AS gap
           FROM p WHERE e IS NOT NULL) t WHERE gap IS NOT NULL""",
    ),
)
def site_eviction_gaps(spark, sf):
    return wn.eviction_gaps(events_stream(spark, sf), 5).where("gap is not null")


@query(
    "window_intervals",
    with_(
        EV,
        "p AS (SELECT *, row_number() OVER (PARTITION BY sid, hid ORDER BY ts, seq) - 1 AS i FROM ev)",
        "SELECT sid, hid, ts, seq, CASE WHEN i >= 5 THEN 0 ELSE ts END AS winterval FROM p",
    ),
)
def window_intervals(spark, sf):
    return wn.window_intervals(events_stream(spark, sf), 5)


@query(
    "sample_hold_integral",
    with_(
        EV,
        "l AS (SELECT *, lag(key) OVER k AS h, lag(ts) OVER k AS t0 FROM ev WINDOW k AS (PARTITION BY sid ORDER BY ts, seq))",
        """SELECT sid, ts, seq, key, CAST(sum(coalesce(h * (ts - t0), 0)) OVER (PARTITION BY sid ORDER BY ts, seq
           ROWS UNBOUNDED PRECEDING) AS BIGINT) AS integral FROM l""",
    ),
)
def sample_hold_integral(spark, sf):
    series = events_stream(spark, sf).select("sid", "ts", "seq", "key")
    return wn.sample_hold_integral(series, "key", ["sid"])




@query(
    "stream_window_counts",
    with_(
        EV,
        """c AS (SELECT sid, upd, ts - ts % 21600 - 21600 * i AS s FROM ev, range(4) r(i))""",
        """SELECT s AS window_start, s + 86400 AS window_end, sid, CAST(sum(upd) AS BIGINT) AS active FROM c
        GROUP BY s, sid HAVING s + 86400 <= (SELECT max(ts) FROM ev)""",
    ),
)
def stream_window_counts(spark, sf):
    """Records of the last day, every six hours, computed incrementally; windows still open are not emitted."""
    schema = table(spark, sf, "events").schema
    feed = event_updates(stream_files(spark, f"{sf}/events.parquet", schema))
    return drain_to_table(window_counts(feed, DAY, DAY // 4))


# -- merging --------------------------------------------------------------------


@query(
    "stream_merge",
    with_(EV, f"""SELECT {_COLS}, 0 AS src FROM ev WHERE sid < 2 UNION ALL SELECT {_COLS}, 1 FROM ev WHERE sid >= 2"""),
)
def stream_merge(spark, sf):
    ev = events_stream(spark, sf)
    return merging.stream_merge(ev.where("sid < 2"), ev.where("sid >= 2"))


@query(
    "stream_merge_order",
    with_(
        EV,
        "m AS (SELECT *, CASE WHEN sid < 2 THEN 0 ELSE 1 END AS src FROM ev)",
        f"SELECT sid, hid, key, upd, ts, src * (SELECT max(seq) - min(seq) + 1 FROM ev) + seq - (SELECT min(seq) FROM ev) AS seq FROM m",
    ),
)
def stream_merge_order(spark, sf):
    ev = events_stream(spark, sf)
    return merging.renumber(merging.stream_merge(ev.where("sid < 2"), ev.where("sid >= 2")))


@query(
    "stream_concat",
    with_(EV, f"SELECT {_COLS}, 0 AS src FROM ev WHERE sid = 3 UNION ALL SELECT {_COLS}, 1 FROM ev WHERE sid <> 3"),
)
def stream_concat(spark, sf):
    ev = events_stream(spark, sf)
    return merging.stream_concat(ev.where("sid = 3"), ev.where("sid <> 3"))


@query(
    "merge_windowed",
    with_(
        EV,
        """m AS (SELECT sid, hid, key, upd, ts, CASE WHEN sid < 2 THEN 0 ELSE 1 END * (SELECT max(seq) - min(seq) + 1 FROM ev)
              + seq - (SELECT min(seq) FROM ev) AS seq FROM ev)""",
        f"SELECT {_COLS}, 0 AS kind FROM m UNION ALL SELECT sid, hid, key, -upd, ts + {DAY}, seq, 1 FROM m",
    ),
)
def merge_windowed(spark, sf):
    ev = events_stream(spark, sf)
    return merging.merge_windowed(DAY, ev.where("sid < 2"), ev.where("sid >= 2"))


# -- predicates and projections ---------------------------------------------------


@query(
    "sel_compare",
    """SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 1000 AND o_totalprice <= 300000 AND o_custkey >= 10
       AND o_custkey < 1400 AND o_orderstatus <> 'P' AND o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW')""",
)
def sel_compare(spark, sf):
    where = [
        ("o_totalprice", pr.greater_than(1000)),
        ("o_totalprice", pr.less_equal(300000)),
        ("o_custkey", pr.greater_equal(10)),
        ("o_custkey", pr.less_than(1400)),
        ("o_orderstatus", pr.not_equal("P")),
        ("o_orderpriority", ["1-URGENT", "2-HIGH", "5-LOW"]),
    ]
    return results.frame(table(spark, sf, "orders"), ["o_orderkey", "o_custkey"], where)


@query("sel_like", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%A%' AND p_type NOT LIKE '%E_'")
def sel_like(spark, sf):
    where = [("p_type", pr.like("%A%")), ("p_type", pr.not_like("%E_"))]
    return results.frame(table(spark, sf, "part"), ["p_partkey", "p_type"], where)


@query("sel_between", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20")
def sel_between(spark, sf):
    return results.frame(table(spark, sf, "part"), ["p_partkey", "p_size"], {"p_size": pr.between(10, 20)})


@query("sel_and_or", "SELECT p_partkey, p_size FROM part WHERE (p_size < 5 OR (p_size > 40 AND p_size <> 45))")
def sel_and_or(spark, sf):
    cond = pr.any_of(pr.less_than(5), pr.all_of(pr.greater_than(40), pr.not_equal(45)))
    return results.frame(table(spark, sf, "part"), ["p_partkey", "p_size"], {"p_size": cond})


@query(
    "sel_approx",
    """SELECT c_custkey, c_acctbal FROM customer WHERE abs(c_acctbal / 5000.0 - 1) <= 0.2 OR abs(c_acctbal) <= 100""",
)
def sel_approx(spark, sf):
    cond = pr.any_of(pr.approx(5000, 0.2), pr.approx(0, 100))
    return results.frame(table(spark, sf, "customer"), ["c_custkey", "c_acctbal"], {"c_acctbal": cond})


@query(
    "project_distinct",
    "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem WHERE l_linenumber = 1",
)
def project_distinct(spark, sf):
    columns = ["l_returnflag", "l_linestatus"]
    return results.frame(table(spark, sf, "lineitem"), columns, {"l_linenumber": 1}, columns, distinct=True)


@query("derived_column", "SELECT p_partkey, p_size / p_retailprice AS ratio FROM part")
def derived_column(spark, sf):
    results.derived_view(table(spark, sf, "part"), "part_ratio", ratio=F.col("p_size") / F.col("p_retailprice"))
    return spark.sql("SELECT p_partkey, ratio FROM part_ratio")


@query(
    "relative_error",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(epoch(l_shipdate)) AS BIGINT) AS ts,
     CASE WHEN l_discount = 0 THEN l_tax ELSE abs((l_discount - l_tax) / l_discount) END AS err FROM lineitem""",
)
def relative_error_query(spark, sf):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.unix_timestamp(F.col("l_shipdate")).alias("ts")]
    err = relative_error(F.col("l_discount"), F.col("l_tax"))
    return table(spark, sf, "lineitem").select(*keys, err.alias("err"))


# -- grids ------------------------------------------------------------------------


def _sizes(spark, sf):
    return grids.values_of(table(spark, sf, "part"), "p_size", "size")


def _segments(spark, sf):
    return grids.values_of(table(spark, sf, "customer"), "c_mktsegment", "segment")


@query(
    "grid_cross",
    "SELECT size, segment FROM (SELECT DISTINCT p_size AS size FROM part), (SELECT DISTINCT c_mktsegment AS segment FROM customer)",
)
def grid_cross(spark, sf):
    return grids.cross(_sizes(spark, sf), _segments(spark, sf))


@query(
    "grid_zip",
    """SELECT n_nationkey, s AS size FROM (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) a
       JOIN (SELECT s, row_number() OVER (ORDER BY s) AS i FROM (SELECT DISTINCT p_size AS s FROM part WHERE p_size <= 25)) b ON a.i = b.i""",
)
def grid_zip(spark, sf):
    nations = table(spark, sf, "nation").select("n_nationkey")
    sizes = _sizes(spark, sf).where("size <= 25")
    return grids.zip_with(nations, sizes, ["n_nationkey"], ["size"])


@query(
    "grid_cross_listed",
    """SELECT size, segment, n_nationkey FROM (SELECT DISTINCT p_size AS size FROM part), (SELECT DISTINCT c_mktsegment AS segment FROM customer),
       (SELECT n_nationkey FROM nation)""",
)
def grid_cross_listed(spark, sf):
    """Every combination of three grids as one list-valued parameter, taken apart again."""
    nations = table(spark, sf, "nation").select("n_nationkey")
    both = grids.cross_listed("runs", _sizes(spark, sf), _segments(spark, sf), nations)
    pick = lambda i, c: F.col("runs")[i][c].alias(c)
    return both.select(pick(0, "size"), pick(1, "segment"), pick(2, "n_nationkey"))


@query(
    "grid_zip_listed",
    """SELECT n_nationkey, s AS size FROM (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) a
       JOIN (SELECT s, row_number() OVER (ORDER BY s) AS i FROM (SELECT DISTINCT p_size AS s FROM part)) b ON a.i = b.i""",
)
def grid_zip_listed(spark, sf):
    """Settings at the same place as one list-valued parameter, up to the end of the shorter grid."""
    nations = table(spark, sf, "nation").select("n_nationkey")
    both = grids.zip_listed("runs", (nations, ["n_nationkey"]), (_sizes(spark, sf), ["size"]))
    return both.select(F.col("runs")[0]["n_nationkey"].alias("n_nationkey"), F.col("runs")[1]["size"].alias("size"))


@query(
    "grid_ops",
    """SELECT setting.size AS size, setting.segment AS segment, setting.weight AS weight FROM (
         SELECT {'size': size, 'segment': segment, 'weight': CAST(size * 2 AS BIGINT)} AS setting FROM (
           SELECT size, segment FROM (SELECT DISTINCT p_size AS size FROM part), (SELECT DISTINCT c_mktsegment AS segment FROM customer)
           WHERE size > 45
           UNION ALL SELECT DISTINCT p_size, NULL FROM part WHERE p_size < 4) t)""",
)
def grid_ops(spark, sf):
    """Concatenate, select, project, nest and unnest."""
    pairs = grids.where_param(grids.cross(_sizes(spark, sf), _segments(spark, sf)), "size", lambda c: c > 45)
    alone = grids.select(_sizes(spark, sf), F.col("size") < 4)
    both = grids.concat(grids.with_param(pairs, "segment"), grids.without_param(alone, "segment"))
    weighted = grids.project(both, weight=(F.col("size") * 2).cast("bigint"))
    return grids.nest(weighted, "setting").select("setting.*")
