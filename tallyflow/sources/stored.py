"""Stored streams: Parquet data with a one-row metadata table beside it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tallyflow.operators.frequency import analyze
from tallyflow.schema import METADATA_SCHEMA, UPDATE_SCHEMA, require_schema, same_fields
from tallyflow.session import cut_lineage

DATA, META, ATTRIBUTES = "data", "meta", "attributes"


def write_stream(
    stream: DataFrame,
    path: str,
    name: str = "stream",
    window: int = 0,
    warmup: int = 0,
    attributes: Mapping[str, str] | None = None,
    mode: str = "errorifexists",
) -> None:
    """Save a stream range-partitioned by time, with its metadata and user attributes.

    Time-clustered files let a later ``ts`` filter skip most row groups.
    """
    require_schema(stream.select(*UPDATE_SCHEMA.names), UPDATE_SCHEMA, "stream")
    clustered = stream.select(*UPDATE_SCHEMA.names).repartitionByRange("ts", "seq").sortWithinPartitions("ts", "seq")
    clustered.write.mode(mode).parquet(f"{path}/{DATA}")
    stored = stream.sparkSession.read.schema(UPDATE_SCHEMA).parquet(f"{path}/{DATA}")
    analyze(stored, name, window, warmup).write.mode(mode).parquet(f"{path}/{META}")
    if attributes:
        pairs = list(attributes.items())
        stream.sparkSession.createDataFrame(pairs, "name string, value string").write.mode(mode).parquet(
            f"{path}/{ATTRIBUTES}"
        )


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """Load a stored stream; wrong columns or missing metadata are errors."""
    read_metadata(spark, path)
    found = spark.read.parquet(f"{path}/{DATA}").schema
    if not same_fields(found, UPDATE_SCHEMA):
        raise ValueError(f"not a stored stream: {found.simpleString()}")
    return spark.read.schema(UPDATE_SCHEMA).parquet(f"{path}/{DATA}")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    try:
        meta = spark.read.parquet(f"{path}/{META}")
    except AnalysisException as e:
        raise ValueError(f"{path} has no stream metadata") from e
    return require_schema(meta, METADATA_SCHEMA, "metadata")


def read_attributes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{ATTRIBUTES}")


def materialize(stream: DataFrame, name: str = "stream") -> tuple[DataFrame, DataFrame]:
    """Fix a stream's content for replay, and its metadata.

    The copy lives in the shared folder, so replays survive lost executors.
    """
    fixed = cut_lineage(stream)
    return fixed, analyze(fixed, name)


