"""Tables that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. A session without that setting gets a machine-local
    folder if it runs in one process; on a cluster it is an error."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="barloom-"))
    return folder or sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """The table checkpointed in the shared folder, so that a lost executor costs no fit twice."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's name inside the shared folder."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, *paths: str) -> None:
    """Deletes folders on whatever file system Spark wrote them to."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
