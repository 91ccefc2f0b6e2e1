"""Tables written in the folder that driver and executors share, where a job reads and replaces the same table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder: spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set, a session on one machine gets a folder of its own; on a cluster that is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder and context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = context.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str = "staged") -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
