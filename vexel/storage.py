"""What iterative operators store between rounds, in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder path under spark.checkpoint.dir. Only a local session may go without that setting; on a cluster, a
    folder of one machine would lose rows."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="vexel-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/vexel-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """Writes df once and reads it back, which cuts its lineage and survives lost executors."""
    path = path or shared_dir(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a folder, through Hadoop's file system interface."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Rounds:
    """Stores the tables of each round and drops those of the round before last, which nothing reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.before, self.now = spark, [], []

    def keep(self, df: DataFrame) -> DataFrame:
        self.now.append(shared_dir(self.spark))
        return stored(df, self.now[-1])

    def next(self) -> None:
        for path in self.before:
            dropped(self.spark, path)
        self.before, self.now = self.now, []
        # Spark deletes the shuffle files of what nobody refers to any more when the driver collects its garbage, which
        # a driver with little to do does seldom.
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
