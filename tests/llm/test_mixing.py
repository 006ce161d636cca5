import random

import pytest
from pyspark.sql import functions as F

from tallyflow.llm import mixing
from tallyflow.llm.scratch import Scratch


def _documents(spark, n=3000):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        source = "src0" if rng.random() < 0.4 else f"src{rng.randrange(1, 6)}"
        lang = "en" if rng.random() < 0.7 else "de"
        text = "word " * rng.randrange(1, 60) if rng.random() < 0.8 else "1234 5678 " * 20
        rows.append((i, text, lang, source))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")


def test_margins_meet_the_targets(spark):
    docs = _documents(spark)
    targets = {
        "source": spark.createDataFrame([(f"src{i}", 1 / 6) for i in range(6)], "source string, share double"),
        "lang": spark.createDataFrame([("en", 0.5), ("de", 0.5)], "lang string, share double"),
    }
    mixed = mixing.mix(docs, targets, fraction=0.2, rounds=20)
    assert mixed.count() == docs.count()
    expected = mixed.select("*", (F.col("tokens") * F.col("probability")).alias("drawn"))
    total = expected.agg(F.sum("drawn")).head()[0]
    assert total == pytest.approx(0.2 * mixed.agg(F.sum("tokens")).head()[0], rel=1e-6)
    for margin, target in targets.items():
        for r in expected.groupBy(margin).agg((F.sum("drawn") / total).alias("part")).join(target, margin).collect():
            assert r.part == pytest.approx(r.share, rel=1e-3)
    drawn = mixed.filter("sampled").agg(F.sum("tokens")).head()[0]
    assert drawn == pytest.approx(total, rel=0.1)


def test_caps_hand_the_rest_to_other_cells(spark):
    cells = spark.createDataFrame(
        [("a", 100, 90.0), ("b", 1000, 10.0), ("c", 50, 0.0)], "source string, tokens bigint, weight double"
    )
    got = {r.source: r.probability for r in mixing.calibrate(cells, 0.5).collect()}
    assert got["a"] == 1.0 and got["c"] == 0.0
    assert got["b"] == pytest.approx((0.5 * 1150 - 100) / 1000)
    assert {r.probability for r in mixing.calibrate(cells.filter("weight > 0"), 1.0).collect()} == {1.0}


def test_values_without_target_have_no_weight(spark):
    cells = spark.createDataFrame([("a", 10), ("b", 30)], "source string, tokens bigint")
    target = spark.createDataFrame([("a", 1.0), ("z", 1.0)], "source string, share double")
    got = {r.source: r.weight for r in mixing.rake(cells, {"source": target}, Scratch(spark), 2).collect()}
    assert got == {"a": 1.0, "b": 0.0}


def test_edge_rows(spark):
    rows = [
        (None, 1, None, None, 3.0),
        ("", 2, "en", "s", 3.0),
        ("a b", None, "en", "s", 3.0),
        ("a b", None, "en", "s", 3.0),
        ("x " * 50_000, 4, None, "s", 3.0),
    ]
    docs = spark.createDataFrame(rows, "text string, doc_id bigint, lang string, source string, probability double")
    got = mixing.mix(docs).collect()
    assert len(got) == 5
    by = {(r.doc_id, r.topic): r for r in got}
    assert by[1, mixing.NONE].probability == 0 and not by[1, mixing.NONE].sampled
    assert by[2, mixing.NONE].tokens == 0
    assert len({(r.probability, r.sampled) for r in got if r.doc_id is None}) == 1
    assert mixing.mix(docs.limit(0)).count() == 0


def test_no_python_in_the_plan(spark, data):
    plan = mixing.mix(spark.read.parquet(f"{data}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
