"""Tables written to the shared folder when a job has to cut its lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def staging_root(spark: SparkSession) -> str:
    """Folder named by `spark.checkpoint.dir`; a local session without one gets its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if root:
        return root.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if own:
        return own.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


_PATHS: list[str] = []


def staging_path(spark: SparkSession, label: str) -> str:
    path = f"{staging_root(spark)}/{label}-{uuid.uuid4().hex}"
    _PATHS.append(path)
    return path


def write_and_read(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write once, read back: later passes neither recompute nor depend on shuffle files."""
    spark = df.sparkSession
    path = staging_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_staging(spark: SparkSession) -> int:
    """Delete the tables this process has staged; call it when no result that reads them is needed."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    deleted = 0
    while _PATHS:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_PATHS.pop())
        deleted += path.getFileSystem(conf).delete(path, True)
    return deleted
