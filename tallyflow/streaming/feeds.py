"""Reading update streams with Structured Streaming, and running them to the end of the input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyflow.session import delete_at_end, shared_folder


def stream_files(
    spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None
) -> DataFrame:
    """Parquet under ``path``, a folder or one file, as a streaming DataFrame.

    The path is given as a glob, the form in which the file source takes both.
    """
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def with_event_time(stream: DataFrame, lateness: str) -> DataFrame:
    """Add ``event_time`` from the integer ``ts`` and bound how late records may come."""
    return stream.withColumn("event_time", F.timestamp_seconds("ts")).withWatermark("event_time", lateness)


def drain_to_table(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Process all available input into Parquet in the shared folder; returns what was written."""
    folder = folder or shared_folder(stream.sparkSession)
    query = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def drain_as_it_comes(stream: DataFrame, folder: str | None = None) -> tuple[DataFrame, int]:
    """Process all input that is there, in as many micro-batches as the source gives; what was written, and their number."""
    folder = folder or shared_folder(stream.sparkSession)
    query = (
        stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress").start()
    )
    try:
        query.processAllAvailable()
        batches = query.lastProgress["batchId"] if query.lastProgress else 0
    finally:
        query.stop()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out"), batches


def drain_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], folder: str) -> None:
    """Process all available input through a micro-batch handler."""
    query = (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def replay(df: DataFrame, by: str) -> DataFrame:
    """``df`` as a stream of one micro-batch per value of ``by``, in its order.

    Each value is written to one file of a folder in the shared space, so this is for
    replaying a few long intervals, not for many short ones.
    """
    spark, folder = df.sparkSession, shared_folder(df.sparkSession)
    for row in df.select(by).distinct().orderBy(by).collect():
        df.where(F.col(by) == row[0]).drop(by).coalesce(1).write.mode("append").parquet(folder)
    delete_at_end(spark, folder)
    # Files are taken in the order of their times.
    return spark.readStream.schema(df.drop(by).schema).option("maxFilesPerTrigger", 1).parquet(folder)
