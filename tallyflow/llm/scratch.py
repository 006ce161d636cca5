"""Intermediate tables in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tallyflow.session import delete_at_end, shared_folder


class Scratch:
    """Parquet tables under one fresh folder of ``spark.checkpoint.dir``.

    ``keep`` cuts the lineage: what is read back does not depend on the executors
    that computed it.  The shuffle files behind it are deleted at once, as nothing
    needs them any more, and Python workers get their rows in batches of bounded size.
    ``drop`` deletes a table that nothing reads any more; the rest goes when the driver ends.
    """

    #: Session settings while a table is written.
    _SETTINGS = {
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
        "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
    }

    def __init__(self, spark: SparkSession) -> None:
        self._spark = spark
        self._root = shared_folder(spark)
        self._written = 0

    @contextmanager
    def bounded(self) -> Iterator[None]:
        """The settings hold for what runs inside."""
        conf = self._spark.conf
        before = {k: conf.get(k, None) for k in self._SETTINGS}
        try:
            for k, v in self._SETTINGS.items():
                conf.set(k, v)
            yield
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self._written += 1
        path = f"{self._root}/{name}-{self._written}"
        with self.bounded():
            df.write.parquet(path)
        if self._written == 1:
            delete_at_end(self._spark, self._root)
        table = self._spark.read.schema(df.schema).parquet(path)
        table.__dict__["_scratch_path"] = path
        return table

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            where = self._spark._jvm.org.apache.hadoop.fs.Path(table.__dict__["_scratch_path"])
            where.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(where, True)
