"""Update streams over business tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Event types coded alphabetically.
EVENT_CODES = {"click": 0, "error": 1, "purchase": 2, "signup": 3, "view": 4}

SITES = 8


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def event_updates(events: DataFrame, sites: int = SITES) -> DataFrame:
    """``events`` as a stream: sid = event type, hid = user shard, key = ``$.k`` of props."""
    sid = F.coalesce(*[F.when(F.col("event_type") == name, F.lit(code)) for name, code in EVENT_CODES.items()])
    return events.select(
        sid.alias("sid"),
        F.pmod(F.col("user_id"), F.lit(sites)).cast("int").alias("hid"),
        F.from_json("props", "k bigint")["k"].alias("key"),
        F.lit(1).cast("bigint").alias("upd"),
        F.unix_timestamp(F.col("ts")).alias("ts"),
        F.col("event_id").alias("seq"),
    )


def events_stream(spark: SparkSession, folder: str) -> DataFrame:
    return event_updates(table(spark, folder, "events"))


def lineitem_stream(spark: SparkSession, folder: str) -> DataFrame:
    """``lineitem`` as a stream without ``seq``: for operators that ignore order."""
    li = table(spark, folder, "lineitem")
    return li.select(
        F.pmod(F.col("l_linenumber"), F.lit(2)).cast("int").alias("sid"),
        F.pmod(F.col("l_suppkey"), F.lit(SITES)).cast("int").alias("hid"),
        F.col("l_partkey").alias("key"),
        F.lit(1).cast("bigint").alias("upd"),
        F.floor(F.unix_timestamp(F.col("l_shipdate")) / 86400).cast("bigint").alias("ts"),
    )
