"""Sources and sinks.  Round trips write derived data to the shared folder and read it back."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyflow.operators.frequency import duration
from tallyflow.plans import jobspec
from tallyflow.plans.catalog.base import EV, query, uniform_int_sql, uniform_unit_sql, with_
from tallyflow.schema import LOCAL_STREAM_STATS_SCHEMA
from tallyflow.session import shared_folder
from tallyflow.sources import generators as gen
from tallyflow.sources import stored, tables
from tallyflow.sources.logs import read_web_log, read_wifi_log
from tallyflow.sources.urls import open_source
from tallyflow.sources.views import events_stream, table
from tallyflow.streaming.feeds import drain_as_it_comes

_COLS = "sid, hid, key, upd, ts, seq"


# -- logs ---------------------------------------------------------------------------


def _write_web_log(events, path: str) -> None:
    """Events as 20-byte records, one file per partition; a retried task rewrites its file."""
    u4 = lambda c: F.unhex(F.lpad(F.hex(c.cast("bigint")), 8, "0"))
    u1 = lambda c: F.unhex(F.lpad(F.hex(c.cast("bigint")), 2, "0"))
    body = F.concat(
        u4(F.col("ts")), u4(F.col("user_id")), u4(F.col("key")), u4(F.col("seq")),
        u1(F.lit(0)), u1(F.lit(200)), u1(F.col("sid")), u1(F.col("hid")),
    )

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        fs.create_dir(root, recursive=True)
        n = 0
        with fs.open_output_stream(f"{root}/part-{TaskContext.get().partitionId():06d}") as out:
            for batch in batches:
                for value in batch.column("body"):
                    out.write(value.as_buffer())
                n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    events.select(body.alias("body")).mapInArrow(save, "n bigint").agg(F.sum("n")).collect()


_WCUP_SQL = with_(
    EV,
    """SELECT CAST(ev.sid AS INTEGER) AS sid, CAST(ev.hid AS INTEGER) AS hid, e.user_id AS key, CAST(1 AS BIGINT) AS upd, ev.ts
    FROM ev JOIN events e ON e.event_id = ev.seq""",
)


def _web_log(spark, sf):
    """Events written as binary web log records."""
    users = table(spark, sf, "events").select(F.col("event_id").alias("seq"), "user_id")
    folder = shared_folder(spark)
    _write_web_log(events_stream(spark, sf).join(users, "seq"), folder)
    return folder


@query("read_wcup", _WCUP_SQL)
def read_wcup(spark, sf):
    """Events written as binary web log records and read back."""
    return read_web_log(spark, _web_log(spark, sf)).drop("seq")


@query("open_source_live", _WCUP_SQL)
def open_source_live(spark, sf):
    """The same log opened by its URL as a live source, in micro-batches of a bounded number of records."""
    most = max(1, table(spark, sf, "events").count() // 3)
    stream = open_source(spark, f"wcup:{_web_log(spark, sf)}?max_records={most}", streaming=True)
    return drain_as_it_comes(stream)[0].drop("seq")


def _wifi_lines(spark, sf):
    e = table(spark, sf, "events")
    ts = F.col("ts")
    return e.select(
        F.concat_ws(
            " ",
            F.when(F.col("event_id") % 3 == 0, "LibBldg").otherwise("AcadBldg"),
            F.concat_ws("-", F.date_format(ts, "yy").cast("int"), F.month(ts), F.dayofmonth(ts)),
            F.concat_ws(":", F.hour(ts), F.minute(ts), F.second(ts)),
            F.concat(F.lit("ap"), F.col("user_id") % 13),
            F.col("user_id") % 27 + 29,
            F.lit("up"),
            F.get_json_object("props", "$.k"),
            F.col("event_id"),
            F.lit("10 20 00:00 7 1 2 3 4 5 6 7 8 9 10.0.0.1"),
        ).alias("value")
    )


_BASE = (365 * 2 + 31 * 7 + 20 - 31) * 86400


@query(
    "read_wifi_log",
    f"""SELECT CAST(CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS INTEGER) AS sid, CAST(user_id % 27 AS INTEGER) AS hid,
     CAST(json_extract_string(props, '$.k') AS BIGINT) AS key, CAST(1 AS BIGINT) AS upd,
     CAST(86400 * (365 * (year(ts) - 2000) + 31 * month(ts) + day(ts) - 31) - {_BASE} + 3600 * hour(ts) + 60 * minute(ts) + floor(second(ts)) AS BIGINT) AS ts
    FROM events""",
)
def read_wifi(spark, sf):
    folder = shared_folder(spark)
    _wifi_lines(spark, sf).write.text(folder)
    return read_wifi_log(spark, folder).drop("seq")


@query(
    "read_wifi_log_parent",
    """WITH p AS (SELECT 'ap' || (user_id % 13) AS parent, * FROM events),
    c AS (SELECT parent, row_number() OVER (ORDER BY parent) - 1 AS code FROM (SELECT DISTINCT parent FROM p) t)
    SELECT CAST((user_id % 27 + 29) % 2 AS INTEGER) AS sid, CAST(code % 5 AS INTEGER) AS hid, event_id AS key,
     CAST(1 AS BIGINT) AS upd, CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM p JOIN c ON c.parent = p.parent""",
)
def read_wifi_parent(spark, sf):
    folder = shared_folder(spark)
    _wifi_lines(spark, sf).write.text(folder)
    return read_wifi_log(spark, folder, "parent", sites=5).drop("seq")


# -- stored streams -------------------------------------------------------------------


@query("read_stream", with_(EV, f"SELECT {_COLS} FROM ev"))
def read_stream(spark, sf):
    folder = shared_folder(spark)
    stored.write_stream(events_stream(spark, sf), folder, "ev")
    return stored.read_stream(spark, folder)


@query(
    "write_stream",
    with_(
        EV,
        """SELECT 'ev' AS name, CAST(count(*) AS BIGINT) AS size, min(ts) AS ts_min, max(ts) AS ts_max,
         array_to_string(list_sort(list(DISTINCT sid)), ',') AS stream_ids, CAST(60 AS BIGINT) AS "window", 'events' AS origin FROM ev""",
    ),
)
def write_stream(spark, sf):
    """Metadata and user attributes of a stored stream."""
    folder = shared_folder(spark)
    stored.write_stream(events_stream(spark, sf), folder, "ev", window=60, attributes={"origin": "events"})
    origin = stored.read_attributes(spark, folder).where("name = 'origin'").select("value").scalar()
    meta = stored.read_metadata(spark, folder)
    return meta.select(
        "name", "size", "ts_min", "ts_max", F.array_join("stream_ids", ",").alias("stream_ids"), "window", origin.alias("origin")
    )


@query("open_source", with_(EV, f"SELECT {_COLS} FROM ev"))
def open_stored_source(spark, sf):
    folder = shared_folder(spark)
    stored.write_stream(events_stream(spark, sf), f"{folder}/ev", "ev")
    return open_source(spark, f"stream:{folder}?dataset=ev")


@query(
    "materialize",
    with_(EV, "SELECT CAST(2 * count(*) AS BIGINT) AS replayed, max(ts) - min(ts) + 1 AS duration FROM ev"),
)
def materialize(spark, sf):
    """Replay a fixed copy twice and compare with its metadata."""
    fixed, meta = stored.materialize(events_stream(spark, sf), "ev")
    twice = fixed.unionByName(fixed).agg(F.count(F.lit(1)).alias("replayed"))
    return twice.withColumn("duration", meta.select(duration().alias("d")).scalar())


# -- generated streams ------------------------------------------------------------------


def _ids(spark, sf):
    return table(spark, sf, "events").select((F.col("event_id") + 1).alias("id"))


_IDS = "ids AS (SELECT event_id + 1 AS id FROM events)"


@query(
    "gen_uniform",
    with_(
        _IDS,
        f"""SELECT CAST({uniform_int_sql('id', 10, 3, 'sid')} AS INTEGER) AS sid, CAST({uniform_int_sql('id', 20, 3, 'hid')} AS INTEGER) AS hid,
         {uniform_int_sql('id', 1000000, 3, 'key')} AS key, CAST(1 AS BIGINT) AS upd, id AS ts, id AS seq FROM ids""",
    ),
)
def gen_uniform(spark, sf):
    """One generated record per event."""
    return gen.uniform_updates(_ids(spark, sf), 10, 20, 1_000_000, seed=3)


@query(
    "gen_poisson",
    with_(
        _IDS,
        f"g AS (SELECT id, CAST(round(-ln({uniform_unit_sql('id', 3, 'gap')}) * (2.5 * 1000000)) AS BIGINT) AS gap FROM ids)",
        f"""SELECT CAST({uniform_int_sql('id', 2, 3, 'sid')} - 1 AS INTEGER) AS sid, CAST({uniform_int_sql('id', 4, 3, 'hid')} - 1 AS INTEGER) AS hid,
         {uniform_int_sql('id', 100, 3, 'key')} - 1 AS key, CAST(1 AS BIGINT) AS upd,
         CAST(sum(gap) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS ts, id AS seq FROM g""",
    ),
)
def gen_poisson(spark, sf):
    return gen.poisson_updates(_ids(spark, sf), 4, 2, 100, 2.5, seed=3)


_ZIPF_N, _ZIPF_THETA = 1000, 0.8


@query(
    "gen_zipf",
    with_(
        _IDS,
        f"z AS (SELECT sum(pow(1.0 / i, {_ZIPF_THETA})) AS zn FROM range(1, {_ZIPF_N + 1}) r(i))",
        f"u AS (SELECT id, zn, {uniform_unit_sql('id', 3, 'zipf')} AS u FROM ids, z)",
        f"e AS (SELECT *, (1 - pow(2.0 / {_ZIPF_N}, {1 - _ZIPF_THETA!r})) / (1 - (1 + pow(0.5, {_ZIPF_THETA})) / zn) AS eta FROM u)",
        f"""SELECT id AS seq, CAST(CASE WHEN u * zn < 1 THEN 1 WHEN u * zn < 1 + pow(0.5, {_ZIPF_THETA}) THEN 2
         ELSE least({_ZIPF_N}, 1 + floor({_ZIPF_N} * pow(eta * u - eta + 1, {1 / (1 - _ZIPF_THETA)!r}))) END AS BIGINT) AS key FROM e""",
    ),
)
def gen_zipf(spark, sf):
    return gen.zipf_updates(_ids(spark, sf), 4, 2, _ZIPF_N, _ZIPF_THETA, seed=3).select("seq", "key")


@query(
    "gen_stable",
    with_(
        _IDS,
        f"""a AS (SELECT id, {uniform_unit_sql('id', 3, 'r')} AS r, {uniform_unit_sql('id', 3, 'n', 'u')} AS nu, {uniform_unit_sql('id', 3, 'n', 'v')} AS nv,
             {uniform_unit_sql('id', 3, 'c')} AS c, {uniform_unit_sql('id', 3, 's', 'u')} AS su, {uniform_unit_sql('id', 3, 's', 'v')} AS sv FROM ids)""",
        """SELECT id, round(-5 + r * 15, 6) AS uniform, round(sqrt(-2 * ln(nu)) * cos(2 * pi() * nv), 6) AS normal,
         round(atan(tan(pi() * (c - 0.5))), 6) AS cauchy_angle,
         round(atan(sin(1.5 * (pi() * (su - 0.5))) / pow(cos(pi() * (su - 0.5)), 1 / 1.5)
           * pow(cos(pi() * (su - 0.5) * (1 - 1.5)) / -ln(sv), (1 - 1.5) / 1.5)), 6) AS stable_angle FROM a""",
    ),
)
def gen_stable(spark, sf):
    """Deviates per id; those with heavy tails are shown as angles."""
    i = F.col("id")
    return _ids(spark, sf).select(
        "id",
        F.round(gen.uniform_deviate(i, -5.0, 10.0, 3, "r"), 6).alias("uniform"),
        F.round(gen.normal_deviate(i, 3, "n"), 6).alias("normal"),
        F.round(F.atan(gen.cauchy_deviate(i, 3, "c")), 6).alias("cauchy_angle"),
        F.round(F.atan(gen.stable_deviate(i, 1.5, 3, "s")), 6).alias("stable_angle"),
    )


# -- tables -----------------------------------------------------------------------------


def _nations(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")


_CUSTOMER = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
_CUSTOMER_SQL = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"


def _schema(ddl):
    return T.StructType.fromDDL(ddl)


@query("read_csvrel", _CUSTOMER_SQL)
def read_csvrel(spark, sf):
    """Two tables written to one text output and told apart again."""
    folder = shared_folder(spark)
    customer = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    tables.write_csvrel(folder, customer=customer, part=table(spark, sf, "part").select("p_partkey", "p_name"))
    schemas = {"customer": _schema(_CUSTOMER), "part": _schema("p_partkey bigint, p_name string")}
    return tables.read_csvrel(spark, folder, schemas)["customer"]


@query("write_csvrel", "SELECT p_partkey, p_name FROM part")
def write_csvrel(spark, sf):
    folder = shared_folder(spark)
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    tables.write_csvrel(folder, part=part, nation=_nations(spark, sf))
    return tables.read_csvrel(spark, folder, {"part": _schema("p_partkey bigint, p_name string")})["part"]


@query("read_csv_table", _CUSTOMER_SQL)
def read_csv_table(spark, sf):
    folder = shared_folder(spark)
    schema = _schema(_CUSTOMER)
    table(spark, sf, "customer").select(*schema.names).write.csv(folder)
    return tables.read_csv_table(spark, folder, schema)


@query("write_csvtab", _CUSTOMER_SQL)
def write_csvtab(spark, sf):
    folder = shared_folder(spark)
    schema = _schema(_CUSTOMER)
    tables.write_csvtab(table(spark, sf, "customer").select(*schema.names), folder)
    return tables.read_csv_table(spark, folder, schema, header=True)


@query("write_result", "SELECT p_partkey, p_size FROM part")
def write_result(spark, sf):
    """A typed table, first replaced and then appended to."""
    folder = shared_folder(spark)
    part = table(spark, sf, "part").select("p_partkey", "p_size")
    tables.write_result(part, folder, "overwrite")
    tables.write_result(part.where("p_size <= 25"), folder, "overwrite")
    tables.write_result(part.where("p_size > 25 OR p_size IS NULL"), folder, "append")
    return spark.read.parquet(folder)


@query("fan_out", "SELECT p_partkey, p_size, count(*) AS copies FROM (SELECT * FROM part UNION ALL SELECT * FROM part) t GROUP BY p_partkey, p_size")
def fan_out(spark, sf):
    """One table bound to three outputs, one of them disabled."""
    folder = shared_folder(spark)
    part = table(spark, sf, "part").select("p_partkey", "p_size")
    bindings = [
        ("parquet", f"{folder}/a", "append", True),
        ("csvtab", f"{folder}/b", "overwrite", True),
        ("parquet", f"{folder}/c", "append", False),
    ]
    paths = tables.fan_out(part, bindings)
    both = spark.read.parquet(paths[0]).unionByName(tables.read_csv_table(spark, paths[1], part.schema, header=True))
    return both.groupBy("p_partkey", "p_size").agg(F.count(F.lit(1)).alias("copies"))


@query("result_schemas", with_(EV, "SELECT sid, hid, CAST(count(*) AS BIGINT) AS stream_len FROM ev GROUP BY sid, hid"))
def result_schemas(spark, sf):
    """Local stream statistics in their declared schema."""
    counts = events_stream(spark, sf).groupBy("sid", "hid").agg(F.count(F.lit(1)).alias("stream_len"))
    folder = shared_folder(spark)
    tables.write_result(counts, folder)
    return spark.read.schema(LOCAL_STREAM_STATS_SCHEMA).parquet(folder)


@query("schema_from_json", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def schema_from_json(spark, sf):
    """A table read with a schema that went through its JSON description."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    name, schema = tables.schema_from_json(tables.schema_to_json("orders", orders.schema))
    folder = os.path.join(shared_folder(spark), name)
    orders.write.csv(folder)
    return tables.read_csv_table(spark, folder, schema)


@query("insert_rows", with_(EV, "SELECT sid, CAST(count(*) AS BIGINT) AS n FROM ev GROUP BY sid UNION ALL SELECT -1, CAST(count(*) AS BIGINT) FROM ev"))
def insert_rows(spark, sf):
    """Per-stream counts as a stored table, with the total inserted as one more tuple."""
    folder = shared_folder(spark)
    counts = events_stream(spark, sf).groupBy("sid").agg(F.count(F.lit(1)).alias("n"))
    tables.write_result(counts, folder)
    total = spark.read.parquet(folder).agg(F.sum("n")).first()[0]
    return tables.insert_rows(spark, folder, counts.schema, [(-1, total)])


# -- jobs -------------------------------------------------------------------------------

_JOB = """{
  // the dataset is the stored event stream
  "dataset": {"data_source": "SOURCE", "hash_streams": 2, "time_window": 604800, "warmup_time": 86400},
  "components": [
    {"name": "sj0", "type": "exact_query", "query": "SELFJOIN", "stream": 0},
    {"name": "j01", "type": "exact_query", "query": "JOIN", "streams": [0, 1]}
  ],
  "files": {"out": "parquet:TARGET?open_mode=append"},
  "bind": {"timeseries": ["out"]}
}"""


@query(
    "job_spec",
    with_(
        EV,
        "e2 AS (SELECT CAST(sid % 2 AS INTEGER) AS sid, key, upd, ts, seq FROM ev)",
        """w AS (SELECT sid, key, upd, ts, 0 AS kind, seq FROM e2 UNION ALL
              SELECT sid, key, -upd, ts + 604800, 1, seq FROM e2 WHERE ts + 604800 < (SELECT max(ts) FROM e2))""",
        """a AS (SELECT *, CASE sid WHEN 0 THEN upd ELSE 0 END AS u1, CASE sid WHEN 1 THEN upd ELSE 0 END AS u2,
              sum(CASE sid WHEN 0 THEN upd ELSE 0 END) OVER k AS a1, sum(CASE sid WHEN 1 THEN upd ELSE 0 END) OVER k AS a2 FROM w
              WINDOW k AS (PARTITION BY key ORDER BY ts, kind, seq ROWS UNBOUNDED PRECEDING))""",
        """r AS (SELECT ts, kind, seq, sid, CAST(sum((2 * a1 - u1) * u1) OVER o AS DOUBLE) AS s,
              CAST(sum(u1 * a2 + u2 * a1) OVER o AS DOUBLE) AS j FROM a WINDOW o AS (ORDER BY ts, kind, seq ROWS UNBOUNDED PRECEDING))""",
        "m AS (SELECT min(ts) + 86400 AS t FROM w)",
        """SELECT ts AS time, kind, seq, 'sj0' AS query, s AS estimate FROM r, m WHERE sid = 0 AND ts >= t
        UNION ALL SELECT ts, kind, seq, 'j01', j FROM r, m WHERE ts >= t""",
    ),
)
def job_spec(spark, sf):
    """A declared job over a stored stream; the answer is read back from its output."""
    folder = shared_folder(spark)
    stored.write_stream(events_stream(spark, sf), f"{folder}/ev", "ev")
    text = _JOB.replace("SOURCE", f"stream:{folder}/ev").replace("TARGET", f"{folder}/out")
    jobspec.run_job(spark, jobspec.load_job(text))
    return spark.read.parquet(f"{folder}/out/timeseries")

