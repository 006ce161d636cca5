"""Run a declared job: a dataset, queries on it, and where their tables go."""

from __future__ import annotations

import json
import re
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.operators.frequency import local_stream_matrix
from tallyflow.operators.joinsize import JoinSizeQuery
from tallyflow.operators.monitor import drift_publish, monitor, monitor_summary, published_estimate
from tallyflow.operators.sampling import sample_series
from tallyflow.operators.segments import Segments
from tallyflow.operators.sketch import Projection, join_estimate_running, selfjoin_estimate_running
from tallyflow.operators.transforms import Preparation, prepare
from tallyflow.session import cut_lineage
from tallyflow.sources.tables import fan_out
from tallyflow.sources.urls import open_source, parse_url

DATASET_KEYWORDS = {"data_source", *(f.name for f in fields(Preparation))}
GUARD_RULES = {"SGM": "any_site", "FGM": "sum", "FRGM": "sum"}


def load_job(text: str) -> dict:
    """Parse JSON that may hold ``//`` comments (outside strings)."""
    plain = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*', lambda m: m.group(1) or "", text)
    return json.loads(plain)


def build_dataset(spark: SparkSession, spec: dict, source: DataFrame | None = None) -> DataFrame:
    """The prepared stream of a ``dataset`` section; ``source`` overrides its URL."""
    unknown = set(spec) - DATASET_KEYWORDS
    if unknown:
        raise ValueError(f"remove {sorted(unknown)} from the dataset; it takes {sorted(DATASET_KEYWORDS)}")
    if source is None:
        if "data_source" not in spec:
            raise ValueError("give the dataset a data_source url, or pass a stream")
        source = open_source(spark, spec["data_source"])
    return prepare(source, Preparation(**{k: v for k, v in spec.items() if k != "data_source"}))


def projection_of(component: dict) -> Projection:
    p = component.get("projection")
    if not p:
        raise ValueError(f"component {component.get('name')!r} needs a projection")
    return Projection(p["depth"], p["width"], p.get("seed", 1), p.get("epsilon"))


def query_of(component: dict) -> JoinSizeQuery:
    kind = component["query"].upper()
    sids = component.get("streams", component.get("stream"))
    sids = sids if isinstance(sids, list) else [sids]
    wanted = {"SELFJOIN": 1, "JOIN": 2}.get(kind)
    if wanted is None or len(sids) != wanted:
        raise ValueError(f"query {kind} takes {wanted} streams, got {sids}")
    return JoinSizeQuery(*sids, beta=component.get("beta", 0.0)) if wanted == 2 else JoinSizeQuery(
        sids[0], beta=component.get("beta", 0.0)
    )


def _sites(stream: DataFrame) -> int:
    return stream.agg(F.count_distinct("hid")).first()[0]


def component_table(
    stream: DataFrame, component: dict, segments: Segments, points: int | None = None
) -> tuple[str, DataFrame]:
    """The result table a component feeds, and its rows; a series can be limited to ``points`` rows."""
    kind, name = component["type"], component.get("name", component["type"])
    if kind == "data_source_statistics":
        return "local_stream_stats", local_stream_matrix(stream.where(~F.col("warmup")))
    query = query_of(component)
    label = F.lit(name).alias("query")
    if kind in ("exact_query", "agms_query"):
        mine = stream.where(F.col("sid").isin(*query.operands))
        order = list(segments.order)
        live = mine.where(~F.col("warmup")).select(*order)
        series = _running(mine.drop("warmup"), query, component, segments)
        if points is not None:
            series = sample_series(series, live, points, segments)
        else:
            series = series.join(mine.where("warmup").select(*order), order, "left_anti")
        return "timeseries", series.select(F.col("ts").alias("time"), *order[1:], label, "estimate")
    proj, every = projection_of(component), component.get("every", 3600)
    sites = _sites(stream)
    # Warm-up records set the first anchor and the first published total; without any, the first slice does.
    live, warm = (stream.where(F.col("warmup") == w).drop("warmup") for w in (False, True))
    warm = warm if warm.take(1) else None
    if kind == "TODS":
        log = cut_lineage(drift_publish(live, proj, component["theta"], sites, every, warm))
        est = published_estimate(log, proj, warm=warm).where(F.col("sid") == query.left)
        return "timeseries", est.select((F.col("slice") * every).alias("time"), label, "estimate")
    if kind in GUARD_RULES:
        rule = GUARD_RULES[kind]
        rounds = monitor(live, query, proj, sites, every, rule, warm=warm)
        return "gm_comm_results", monitor_summary(rounds, query, proj, sites, rule)
    raise ValueError(f"unknown component type {kind!r}")


def _running(stream: DataFrame, query: JoinSizeQuery, component: dict, segments: Segments) -> DataFrame:
    if component["type"] == "exact_query":
        return query.running(stream, segments)
    proj = projection_of(component)
    if query.is_selfjoin:
        return selfjoin_estimate_running(stream, proj, segments)
    return join_estimate_running(stream, query.left, query.right, proj, segments)


def run_job(spark: SparkSession, job: dict, source: DataFrame | None = None) -> dict[str, DataFrame]:
    """Build all result tables of a job, sample and write them as bound, and return them."""
    stream = build_dataset(spark, job["dataset"], source)
    segments = Segments.fit(stream)
    tables: dict[str, DataFrame] = {}
    limits = job.get("sample", {})
    for component in job.get("components", []):
        table, rows = component_table(stream, component, segments, limits.get("timeseries"))
        tables[table] = tables[table].unionByName(rows, allowMissingColumns=True) if table in tables else rows
    files = {name: parse_url(url) for name, url in job.get("files", {}).items()}
    for table, targets in job.get("bind", {}).items():
        if table not in tables:
            continue
        bindings = []
        for target in targets:
            url = files[target]
            fmt = "parquet" if url.type in ("parquet", "hdf5") else url.format
            mode = "append" if url.mode == "append" else "overwrite"
            bindings.append((fmt, f"{url.path}/{table}", mode, url.type != "stdout"))
        fan_out(tables[table], bindings)
        if any(files[t].type == "stdout" for t in targets):
            tables[table].show(truncate=False)
    return tables
