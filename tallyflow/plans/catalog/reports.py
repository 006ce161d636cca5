"""Result-table analytics and message traffic.

The traffic table is derived from ``events``: one channel per (network, source,
destination, endpoint) with its messages and bytes.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyflow.functions import predicates as pr
from tallyflow.operators import results, traffic
from tallyflow.plans.catalog.base import DAY, EV, query, with_
from tallyflow.sources.views import events_stream, table

TRAFFIC = """traffic AS (
  SELECT 'r1' AS run_id, 'net' || (sid % 2) AS netname, 'demo' AS protocol, hid AS src, CAST(key % 5 AS INTEGER) AS dst,
         CAST((key % 3) * 256 + key % 8 AS BIGINT) AS endp, CAST(count(*) AS BIGINT) AS msgs, CAST(sum(key * 4) AS BIGINT) AS bytes
  FROM ev GROUP BY sid % 2, hid, key % 5, (key % 3) * 256 + key % 8)"""
INTERFACES = """interfaces AS (
  SELECT DISTINCT 'r1' AS run_id, netname, protocol, endp - endp % 2 AS rpcc, 'i' || (endp // 256) AS iface,
         'm' || (endp % 256 // 2) AS method, (endp // 2) % 2 = 1 AS oneway FROM traffic)"""
_CHANNEL = "run_id, netname, protocol, src, dst, endp, msgs, bytes"


def _traffic(spark, sf):
    ev = events_stream(spark, sf)
    key = F.col("key")
    rows = ev.select(
        F.lit("r1").alias("run_id"),
        F.concat(F.lit("net"), F.col("sid") % 2).alias("netname"),
        F.lit("demo").alias("protocol"),
        F.col("hid").alias("src"),
        (key % 5).cast("int").alias("dst"),
        ((key % 3) * 256 + key % 8).alias("endp"),
        (key * 4).alias("b"),
    )
    keys = ["run_id", "netname", "protocol", "src", "dst", "endp"]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("msgs"), F.sum("b").alias("bytes"))


def _interfaces(channels):
    e = F.col("endp")
    return channels.select(
        "run_id",
        "netname",
        "protocol",
        (e - e % 2).alias("rpcc"),
        F.concat(F.lit("i"), F.expr("endp div 256")).alias("iface"),
        F.concat(F.lit("m"), F.expr("endp % 256 div 2")).alias("method"),
        (F.expr("endp div 2") % 2 == 1).alias("oneway"),
    ).distinct()


@query(
    "traffic_by_method",
    with_(
        EV,
        TRAFFIC,
        INTERFACES,
        """eps AS (SELECT netname, rpcc AS endp, method FROM interfaces UNION ALL
              SELECT netname, rpcc + 1, method FROM interfaces WHERE NOT oneway)""",
        """SELECT t.netname, method, CAST(sum(msgs) AS BIGINT) AS msgs, CAST(sum(bytes) AS BIGINT) AS bytes,
         CAST(20 * sum(msgs) + sum(bytes) AS BIGINT) AS total FROM traffic t JOIN eps ON eps.netname = t.netname AND eps.endp = t.endp
        GROUP BY t.netname, method""",
    ),
)
def traffic_by_method(spark, sf):
    channels = _traffic(spark, sf)
    return traffic.by_method_totals(channels, _interfaces(channels))


@query(
    "traffic_filter",
    with_(
        EV,
        TRAFFIC,
        f"""SELECT {_CHANNEL} FROM traffic WHERE src IN (1, 2, 3) AND dst NOT IN (4) AND dst <> 0
        AND (endp & -256) = 256 AND (endp & 1) = 0 AND (endp & -2) = 260""",
    ),
)
def traffic_filter(spark, sf):
    """Requests of one method from three hosts to single hosts, without destination 0."""
    t = traffic.by_source(_traffic(spark, sf), 1, 2, 3)
    t = traffic.by_destination(traffic.unicast(t, [4]), 1, 2, 3)
    return traffic.by_method(traffic.requests(traffic.by_interface(t, 256)), 260)


@query("traffic_multicast", with_(EV, TRAFFIC, f"SELECT {_CHANNEL} FROM traffic WHERE dst = 4 AND (endp & 1) = 1"))
def traffic_multicast(spark, sf):
    return traffic.responses(traffic.multicast(_traffic(spark, sf), [4]))


@query(
    "traffic_tally",
    with_(
        EV,
        TRAFFIC,
        """SELECT netname, CAST(sum(msgs) AS BIGINT) AS msgs, CAST(sum(bytes) AS BIGINT) AS bytes,
         CAST(sum(CASE WHEN dst = 4 THEN msgs * 3 ELSE msgs END) AS BIGINT) AS received FROM traffic GROUP BY netname""",
    ),
)
def traffic_tally(spark, sf):
    received = F.when(F.col("dst") == 4, F.col("msgs") * 3).otherwise(F.col("msgs"))
    return traffic.tally(_traffic(spark, sf), ["netname"], received=received)


@query("traffic_union", with_(EV, TRAFFIC, f"SELECT {_CHANNEL} FROM traffic WHERE src < 4 OR dst = 1"))
def traffic_union(spark, sf):
    t = _traffic(spark, sf)
    return traffic.union(t.where("src < 4"), traffic.by_destination(t, 1))


@query("traffic_except", with_(EV, TRAFFIC, f"SELECT {_CHANNEL} FROM traffic WHERE src < 4 AND dst <> 1"))
def traffic_except(spark, sf):
    t = _traffic(spark, sf)
    return traffic.difference(t.where("src < 4"), traffic.by_destination(t, 1))


@query(
    "comm_summary",
    with_(
        EV,
        TRAFFIC,
        """m AS (SELECT CAST(count(*) AS BIGINT) AS n, max(ts) - min(ts) + 1 AS d, count(DISTINCT sid) AS s, count(DISTINCT hid) AS h FROM ev)""",
        """SELECT run_id, netname, protocol, 'ev' AS dset_name, CAST(0 AS BIGINT) AS dset_window, CAST(0 AS BIGINT) AS dset_warmup, n AS dset_size,
         d AS dset_duration, CAST(s AS INTEGER) AS dset_streams, CAST(h AS INTEGER) AS dset_hosts, n * 16 AS dset_bytes,
         CAST(sum(msgs) AS BIGINT) AS total_msg, CAST(sum(bytes) AS BIGINT) AS total_bytes, CAST(sum(bytes) AS DOUBLE) / (n * 16) AS traffic_ratio
        FROM traffic, m GROUP BY run_id, netname, protocol, n, d, s, h""",
    ),
)
def comm_summary(spark, sf):
    return results.comm_summary(events_stream(spark, sf), _traffic(spark, sf), "ev")


@query("axis_values", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def axis_values(spark, sf):
    return results.axis_values(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("frame", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal < 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
def frame(spark, sf):
    where = {"c_acctbal": pr.less_than(0), "c_mktsegment": ["BUILDING", "MACHINERY"]}
    columns = ["c_nationkey", "c_mktsegment"]
    return results.frame(table(spark, sf, "customer"), columns, where, columns, distinct=True)


_DAILY = f"""daily AS (SELECT sid, hid, ts // {DAY} AS day, CAST(count(*) AS BIGINT) AS records, CAST(sum(key) AS BIGINT) AS keys
 FROM ev GROUP BY sid, hid, ts // {DAY})"""


def _daily(spark, sf):
    day = F.expr(f"ts div {DAY}L").alias("day")
    return events_stream(spark, sf).groupBy("sid", "hid", day).agg(F.count(F.lit(1)).alias("records"), F.sum("key").alias("keys"))


@query("series_extract", with_(EV, _DAILY, "SELECT sid, hid, day AS x, records AS y FROM daily WHERE sid <> 3"))
def series_extract(spark, sf):
    return results.series(_daily(spark, sf), "day", "records", ["sid", "hid"], {"sid": pr.not_equal(3)})


@query(
    "series_extract_multi",
    with_(
        EV,
        _DAILY,
        """SELECT sid, hid, day AS x, 'records' AS series, CAST(records AS DOUBLE) AS y FROM daily
        UNION ALL SELECT sid, hid, day, 'keys', CAST(keys AS DOUBLE) FROM daily""",
    ),
)
def series_extract_multi(spark, sf):
    return results.series(_daily(spark, sf), "day", ["records", "keys"], ["sid", "hid"])
