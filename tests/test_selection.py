"""Cuts by position without sorting, and streams that end at a record."""

import pytest
from pyspark.sql import functions as F

from tallyflow.operators import selection
from tallyflow.operators.transforms import max_length, position_slice, record_map
from tests.helpers import frame, random_updates

ROWS = [(s, h, k, 1, t, i) for i, (s, h, k, _, t, *_) in enumerate(random_updates(300, seed=5))]
ORDER = sorted(ROWS, key=lambda r: (r[4], r[5]))


@pytest.mark.parametrize("stretches", [2, 4096])
def test_positions_without_sorting(spark, monkeypatch, stretches):
    monkeypatch.setattr(selection, "STRETCHES", stretches)
    stream = frame(spark, ROWS).repartition(4)
    for n in (0, 1, 17, 299, 300, 1000):
        assert sorted(map(tuple, max_length(stream, n).collect())) == sorted(ORDER[:n])
    for a, b in ((0, 5), (3, 3), (10, 40), (250, 900), (300, 400)):
        assert sorted(map(tuple, position_slice(stream, a, b).collect())) == sorted(ORDER[a:b])


def test_the_bound_reaches_the_scan(spark, tmp_path):
    frame(spark, ROWS).write.parquet(str(tmp_path / "s"))
    cut = max_length(spark.read.parquet(str(tmp_path / "s")), 50)
    plan = cut._jdf.queryExecution().toString()
    assert "LessThanOrEqual(ts," in plan and "Sort" not in plan and "Window" not in plan and "Exchange" not in plan


def test_records_with_one_order_key(spark):
    same = frame(spark, [(0, 0, k, 1, 5, 7) for k in range(10)] + [(0, 0, 99, 1, 4, 0), (0, 0, 98, 1, 9, 9)])
    for n in range(13):
        assert max_length(same, n).count() == min(n, 12)
    parts = [position_slice(same, a, b) for a, b in ((0, 1), (1, 4), (4, 11), (11, 12))]
    assert [p.count() for p in parts] == [1, 3, 7, 1]
    assert parts[0].head().key == 99 and parts[3].head().key == 98


def test_stream_ends_at_the_first_record_that_meets_a_condition(spark):
    stream = frame(spark, ROWS).repartition(4)
    for key in (ORDER[0][2], ORDER[120][2], -5):
        got = record_map(stream, lambda s: s.withColumn("upd", -F.col("upd")), lambda s: F.col("key") == key).collect()  # noqa: B023
        end = next((i for i, r in enumerate(ORDER) if r[2] == key), len(ORDER))
        assert sorted(tuple(r) for r in got) == sorted((s, h, k, -u, t, i) for s, h, k, u, t, i in ORDER[:end])
