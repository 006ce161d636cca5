import os
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyflow.operators import grids
from tallyflow.operators.frequency import analyze, merge_metadata
from tallyflow.operators.joinsize import JoinSizeQuery
from tallyflow.operators.merging import merge_windowed, renumber, stream_merge
from tallyflow.operators.results import series
from tallyflow.operators.transforms import record_map
from tallyflow.plans import jobspec
from tallyflow.schema import COMM_RESULTS_SCHEMA, METADATA_SCHEMA, UPDATE_SCHEMA, same_fields
from tallyflow.session import shared_folder
from tallyflow.sources import generators as gen
from tallyflow.sources import stored, tables
from tallyflow.sources.logs import read_web_log, read_wifi_log
from tallyflow.sources.urls import open_source, parse_url
from tallyflow.streaming.feeds import drain_as_it_comes
from tests.helpers import collect, frame, random_updates

ROWS = random_updates(120, seed=2)


def test_web_log(spark, tmp_path):
    rows = [(894_000_000 + i, i % 50, i * 3, i, 1, 200, i % 9, i % 31) for i in range(1000)]
    for part in range(2):
        body = b"".join(struct.pack(">IIIIBBBB", *r) for r in rows[part * 500 : part * 500 + 500])
        (tmp_path / f"day{part}").write_bytes(body)
    got = read_web_log(spark, str(tmp_path))
    assert same_fields(got.schema, UPDATE_SCHEMA)
    want = [(r[6], r[7], r[1], 1, r[0], i) for i, r in enumerate(rows)]
    assert collect(got, "sid", "hid", "key", "upd", "ts", "seq") == sorted(want)
    other = read_web_log(spark, str(tmp_path), "method", "server", "object")
    assert collect(other, "sid", "key") == sorted((1, r[2]) for r in rows)
    small = spark.read.format("web_log").option("split_records", 77).load(str(tmp_path))
    assert small.rdd.getNumPartitions() == 14 and collect(small, "seq") == [(i,) for i in range(1000)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and "RDD" not in plan and "MapInArrow" not in plan


def test_web_log_as_it_grows(spark, tmp_path):
    def record(i):
        return struct.pack(">IIIIBBBB", 1000 + i, i, 0, 0, 1, 200, i % 5, i % 3)

    folder, out = tmp_path / "log", str(tmp_path / "out")
    folder.mkdir()
    (folder / "a").write_bytes(b"".join(map(record, range(100))))
    live = lambda: open_source(spark, f"wcup:{folder}?max_records=40", streaming=True)
    rows, batches = drain_as_it_comes(live(), out)
    assert batches >= 2 and collect(rows, "seq", "ts") == [(i, 1000 + i) for i in range(100)]
    with open(folder / "a", "ab") as f:
        f.write(b"".join(map(record, range(100, 130))))
    (folder / "b").write_bytes(b"".join(map(record, range(130, 150))))
    rows, _ = drain_as_it_comes(live(), out)
    assert collect(rows, "seq", "key") == [(i, i) for i in range(150)]


def test_web_log_of_broken_records(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"1" * 21)
    with pytest.raises(Exception, match="whole records"):
        read_web_log(spark, str(tmp_path)).count()
    (tmp_path / "x").write_bytes(b"")
    assert read_web_log(spark, str(tmp_path)).count() == 0
    for bad in ("gen:uniform?maxsid=1,maxhid=1,maxkey=1,maxts=1", "crawdad:x"):
        with pytest.raises(ValueError, match="live"):
            open_source(spark, bad, streaming=True)


def test_stored_stream_as_it_grows(spark, tmp_path):
    path = str(tmp_path / "s")
    stored.write_stream(frame(spark, [(0, 1, 2, 1, 3, 4)]), path)
    rows, _ = drain_as_it_comes(open_source(spark, f"stream:{path}?max_files=1", streaming=True))
    assert collect(rows, "sid", "hid", "key", "upd", "ts", "seq") == [(0, 1, 2, 1, 3, 4)]


WIFI = [
    "LibBldg1 2-7-20 00:00:05 p1 30 up 120 4000 -60 9 aa:bb c1 1 2 3 4 5 6 7 8 9 1.2.3.4",
    "AcadBldg 2-8-01 10:20:30 p2 31 up 77 5000 -60 9 aa:bb c1 1 2 3 4 5 6 7 8 9 1.2.3.4",
    "ResBldg 3-1-02 00:00:00 p1 55 up 3 6000 -60 9 aa:bb c1 1 2 3 4 5 6 7 8 9 1.2.3.4",
]


def test_wifi_log(spark, tmp_path):
    path = tmp_path / "log.txt"
    path.write_text("\n".join(WIFI) + "\n")
    got = collect(read_wifi_log(spark, str(path)), "ts", "sid", "hid", "key")
    month = 86400 * (31 + 1 - 20) + 10 * 3600 + 20 * 60 + 30
    year = 86400 * (365 + 31 * (1 - 7) + 2 - 20)
    assert got == [(5, 0, 1, 120), (month, 1, 2, 77), (year, 1, 26, 3)]
    named = collect(read_wifi_log(spark, str(path), "parent"), "key", "sid", "hid", "ts")
    assert named == [(4000, 0, 0, 1027123205), (5000, 1, 1, 1028197230), (6000, 1, 0, 1041465600)]
    reduced = read_wifi_log(spark, str(path), sites=2, streams=1)
    assert {r["sid"] for r in reduced.collect()} == {0} and {r["hid"] for r in reduced.collect()} <= {0, 1}
    path.write_text("too short\n")
    with pytest.raises(Exception, match="malformed"):
        read_wifi_log(spark, str(path)).collect()


def test_stored_stream_round_trip(spark):
    folder = shared_folder(spark)
    stored.write_stream(frame(spark, ROWS), folder, "s", window=7, attributes={"a": "b"})
    back = stored.read_stream(spark, folder)
    assert collect(back, "sid", "hid", "key", "upd", "ts", "seq") == sorted(ROWS)
    meta = stored.read_metadata(spark, folder).first()
    assert (meta["size"], meta["window"], meta["stream_ids"]) == (120, 7, [0, 1, 2])
    assert collect(stored.read_attributes(spark, folder), "name", "value") == [("a", "b")]
    with pytest.raises(ValueError, match="no stream metadata"):
        stored.read_stream(spark, folder + "-none")
    wrong = shared_folder(spark)
    frame(spark, ROWS).drop("key").write.parquet(f"{wrong}/data")
    analyze(frame(spark, ROWS)).write.parquet(f"{wrong}/meta")
    with pytest.raises(ValueError, match="not a stored stream"):
        stored.read_stream(spark, wrong)


def test_urls(spark):
    u = parse_url("stream:/data/2024-05 traffic/part?dataset=west,note=a:b?c")
    assert (u.type, u.path) == ("stream", "/data/2024-05 traffic/part")
    assert u.options == {"dataset": "west", "note": "a:b?c"} and (u.mode, u.format) == ("truncate", "csvtab")
    assert parse_url("wcup:").path == "" and parse_url("hdf5:s3://bucket/x").path == "s3://bucket/x"
    assert parse_url("out:t.csv?format=csvrel,open_mode=append").mode == "append"
    for bad in ("", "stream", "9x:p", "a b:p", "s:p?", "s:p?k", "s:p?k=", "s:p?=v", "s:p?k=v,,j=w", "s:p?open_mode=new", "s:p?format=xml"):
        with pytest.raises(ValueError):
            parse_url(bad)


def test_open_generated_source(spark):
    s = open_source(spark, "gen:uniform?maxsid=3,maxhid=5,maxkey=70,maxts=900")
    low, high, n = s.agg(F.min("ts"), F.max("ts"), F.count("*")).first()
    assert (low, high, n) == (1, 900, 900)
    for bad in ("gen:uniform?maxsid=3", "gen:poisson", "kafka:topic", "gen:uniform?maxsid=3,maxhid=five,maxkey=7,maxts=9"):
        with pytest.raises(ValueError):
            open_source(spark, bad)


def test_uniform_source_covers_its_ranges_and_repeats(spark):
    s = gen.gen_uniform(spark, 4, 7, 300, 8_000, seed=11)
    seen = s.agg(*[F.countDistinct(c) for c in ("sid", "hid", "key", "upd", "ts")]).first()
    assert tuple(seen) == (4, 7, 300, 1, 8_000)
    assert s.exceptAll(gen.gen_uniform(spark, 4, 7, 300, 8_000, seed=11).repartition(5)).count() == 0
    other = gen.gen_uniform(spark, 4, 7, 300, 8_000, seed=12)
    assert s.exceptAll(other).count() > 7_000
    # Chi-square of 300 equally likely keys: mean 299, standard deviation about 24.
    counts = [r["count"] for r in s.groupBy("key").count().collect()]
    assert 200 < sum((c - 8_000 / 300) ** 2 for c in counts) / (8_000 / 300) < 420


def test_generated_distributions(spark):
    n = 20_000
    ids = spark.range(1, n + 1)
    z = gen.gen_zipf(spark, n, 2, 2, 100, 0.9).groupBy("key").count()
    top = {r["key"]: r["count"] / n for r in z.collect()}
    zeta = sum(i**-0.9 for i in range(1, 101))
    assert abs(top[1] - 1 / zeta) < 0.02 and abs(top[2] - 2**-0.9 / zeta) < 0.02 and max(top) <= 100
    p = gen.gen_poisson(spark, n, 2, 2, 50, 3.0)
    assert abs(p.agg(F.max("ts")).first()[0] / 1e6 / n - 3.0) < 0.1
    i = F.col("id")
    row = ids.select(
        F.avg(gen.stable_deviate(i, 2, "a")), F.stddev(gen.stable_deviate(i, 2, "a")),
        F.median(gen.stable_deviate(i, 1, "b")), F.median(gen.stable_deviate(i, 1.3, "c")),
        F.avg((F.abs(gen.stable_deviate(i, 1, "b")) < 1).cast("double")),
        F.avg((gen.stable_deviate(i, 0.4, "d") > 0).cast("double")),
    ).first()
    for got, want in zip(row, (0, 2**0.5, 0, 0, 0.5, 0.5)):
        assert abs(got - want) < 0.05
    with pytest.raises(ValueError):
        gen.stable_deviate(i, 0.001)


def test_csv_texts(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", 0.5), (2, 'q"t', 1.25)], "n int, s string, x double")
    rel, tab = str(tmp_path / "rel"), str(tmp_path / "tab")
    tables.write_csvrel(rel, T1=df.coalesce(1), other=df.select("n").coalesce(1))
    assert collect(tables.read_csvrel(spark, rel, {"T1": df.schema})["T1"], "n", "s", "x") == collect(df, "n", "s", "x")
    lines = sorted(r[0] for r in spark.read.text(rel).collect())
    assert "other,1" in lines and 'T1,1,"a,b",0.5' in lines
    tables.write_csvtab(df.drop("s").coalesce(1), tab)
    (part,) = [f for f in os.listdir(tab) if f.startswith("part")]
    assert open(os.path.join(tab, part)).read() == "n,x\n1,0.5\n2,1.25\n"


def test_append_checks_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, 2.0)], "a bigint, b double")
    tables.write_result(df, path)
    tables.write_result(df, path)
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(ValueError, match="append"):
        tables.write_result(df.withColumn("b", F.col("b").cast("int")), path)
    assert tables.insert_rows(spark, path, df.schema, [(7, 1.0), (8, 1.0)]).count() == 4


def test_schema_json():
    text = """{"name": "t", "columns": [{"name": "a", "type": "int", "arithmetic": true},
      {"name": "b", "type": "long double", "arithmetic": true}, {"name": "c", "type": "char*", "arithmetic": false}]}"""
    name, schema = tables.schema_from_json(text)
    assert name == "t"
    assert [f.dataType for f in schema] == [T.LongType(), T.DoubleType(), T.StringType()]
    assert tables.schema_from_json(tables.schema_to_json(name, schema))[1] == schema
    assert len(COMM_RESULTS_SCHEMA) == 14 and len(METADATA_SCHEMA) == 10


def test_job_text_and_errors(spark):
    job = jobspec.load_job('{ // note\n "a": "x//y", // more\n "b": 1 }')
    assert job == {"a": "x//y", "b": 1}
    with pytest.raises(ValueError, match="remove"):
        jobspec.build_dataset(spark, {"data_source": "gen:uniform", "windw": 3})
    with pytest.raises(ValueError, match="data_source"):
        jobspec.build_dataset(spark, {})
    with pytest.raises(ValueError):
        jobspec.query_of({"query": "JOIN", "stream": 0})


def test_job_with_all_components(spark):
    proj = {"depth": 3, "width": 60}
    job = {
        "dataset": {"hash_streams": 2, "warmup_size": 10},
        "components": [
            {"type": "data_source_statistics"},
            {"name": "x", "type": "exact_query", "query": "SELFJOIN", "stream": 0},
            {"name": "s", "type": "agms_query", "query": "SELFJOIN", "stream": 0, "projection": proj},
            {"name": "j", "type": "agms_query", "query": "JOIN", "streams": [0, 1], "projection": proj},
            {"name": "t", "type": "TODS", "query": "SELFJOIN", "stream": 0, "projection": proj, "theta": 0.3, "every": 20},
            {"name": "f", "type": "FGM", "query": "SELFJOIN", "stream": 0, "projection": proj, "beta": 0.9, "every": 20},
        ],
        "sample": {"timeseries": 5},
    }
    out = jobspec.run_job(spark, job, frame(spark, ROWS))
    assert set(out) == {"local_stream_stats", "timeseries", "gm_comm_results"}
    assert out["gm_comm_results"].first()["protocol"] == "sum"
    counts = dict(collect(out["timeseries"].groupBy("query").count(), "query", "count"))
    assert (counts["x"], counts["s"], counts["j"]) == (5, 5, 5) and counts["t"] >= 1


def test_query_objects():
    assert JoinSizeQuery(1, 2) != JoinSizeQuery(2, 1)
    assert JoinSizeQuery(2) == JoinSizeQuery(2) and JoinSizeQuery(2, 2).is_selfjoin
    assert str(JoinSizeQuery(1, 2)) == "join(1,2)" and str(JoinSizeQuery(3)) == "selfjoin(3)"
    with pytest.raises(ValueError):
        JoinSizeQuery(1, beta=-0.1)


def test_metadata_merge(spark):
    a, b = ROWS[:50], ROWS[50:]
    parts = analyze(frame(spark, a), "a").unionByName(analyze(frame(spark, b), "b"))
    whole = analyze(frame(spark, ROWS), "merged").first()
    assert merge_metadata(parts).first().asDict() == whole.asDict()


def test_merge_keeps_input_order_on_ties(spark):
    a = [(0, 0, 1, 1, 5, 10), (0, 0, 2, 1, 7, 11)]
    b = [(1, 0, 3, 1, 5, 1), (1, 0, 4, 1, 6, 2)]
    merged = renumber(stream_merge(frame(spark, a), frame(spark, b))).orderBy("ts", "seq")
    assert [r["key"] for r in merged.collect()] == [1, 3, 4, 2]
    assert merge_windowed(3, frame(spark, a), frame(spark, b)).agg(F.sum("upd")).first()[0] == 0


def test_grid_algebra(spark):
    x, y = grids.param(spark, "x", [1, 2]), grids.param(spark, "y", [3, 4])
    assert collect(grids.zip_with(x, y, ["x"], ["y"]), "x", "y") == [(1, 3), (2, 4)]
    assert collect(grids.cross(x, y), "x", "y") == [(1, 3), (1, 4), (2, 3), (2, 4)]
    assert collect(grids.zip_with(x, grids.param(spark, "y", [9]), ["x"], ["y"]), "x", "y") == [(1, 9), (2, 9)]
    with pytest.raises(ValueError):
        grids.zip_with(x, grids.param(spark, "y", [1, 2, 3]), ["x"], ["y"])
    both = grids.concat(x, y)
    assert grids.with_param(both, "x").count() == 2 and grids.without_param(both, "x").count() == 2
    assert grids.without_param(x, "z").count() == 2 and grids.with_param(x, "z").count() == 0
    assert collect(grids.nest(x, "p").select("p.x"), "x") == [(1,), (2,)]


def test_long_series(spark):
    df = spark.createDataFrame([("a", 1, 5, 6.0), ("a", 2, 7, 8.0)], "k string, t int, u int, v double")
    got = collect(series(df, "t", ["u", "v"], ["k"]), "series", "x", "y")
    assert got == [("u", 1, 5.0), ("u", 2, 7.0), ("v", 1, 6.0), ("v", 2, 8.0)]


def test_record_map_must_keep_columns(spark):
    with pytest.raises(ValueError):
        record_map(frame(spark, ROWS), lambda s: s.drop("key"))
