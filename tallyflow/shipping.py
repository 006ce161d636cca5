"""Makes this package importable on the workers."""

from __future__ import annotations

import functools
import io
import os
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyflow.session import shared_folder

_PACKAGE = os.path.dirname(os.path.abspath(__file__))


def _archive() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(_PACKAGE):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(_PACKAGE)))
    return out.getvalue()


def ship(spark: SparkSession) -> None:
    """Adds the package to the session once, as an archive in the shared folder."""
    context = spark.sparkContext
    if getattr(context, "_tallyflow_shipped", False):
        return
    path = f"{shared_folder(spark)}/tallyflow.zip"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where)
    stream.write(_archive())
    stream.close()
    context.addPyFile(path)
    context._tallyflow_shipped = True


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, with the package shipped before it is built."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
