"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "tallyflow", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests, the bench and local work, with this package known to its workers.

    On a cluster the submitter supplies the session, and installs the package or calls ``shipping.ship``.
    """
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tallyflow.shipping import ship

    ship(spark)
    return spark


@cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="tallyflow-")


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder under the one the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to a temporary folder;
    on a cluster a machine-local folder would be lost with its executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local_root()
    return os.path.join(root, f"tallyflow-{uuid.uuid4().hex}")


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared scratch space when the driver ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; survives lost executors.

    The copy is deleted when the driver ends.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    delete_at_end(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
