"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallyflow.plans.catalog import QUERIES  # noqa: E402
from tallyflow.session import local_session  # noqa: E402

HEADLINE = (
    "analyze",
    "frequency_vector",
    "selfjoin_exact",
    "join_exact",
    "join_size_matrix",
    "selfjoin_running",
    "selfjoin_running_window",
    "join_running",
    "sketch_build",
    "sketch_accuracy",
    "selfjoin_sketch_running",
    "join_sketch_running",
    "point_estimate",
    "time_window",
    "count_window",
    "site_time_window",
    "active_series",
    "sample_n_of_N",
    "level_changed",
    "guard_selfjoin",
    "guard_join",
    "drift_publish",
    "monitor_any_site",
    "monitor_sum",
    "traffic_by_method",
    "median",
)


#: Each query runs so often; the median counts.
RUNS = 3


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "tallyflow-bench")
    # One small query first: starting the engine is not part of any query.
    QUERIES["frequency_vector"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(RUNS):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(median(runs), 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
