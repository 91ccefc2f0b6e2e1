"""Helpers that several text operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set, a session on one machine gets a folder of its own; on a cluster that is an error.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found and context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = context.getCheckpointDir()
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


ROW_KEY = "row_key__"


def row_keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """docs, and the column that names each of its rows: the id where it is set and unique throughout.

    Otherwise docs are written once with numbers that ascend by id (nulls last), then by text digest; equal rows are
    numbered apart, in any order.
    """
    if docs.groupBy(id_col).agg(F.count("*").alias("n__")).where(F.col(id_col).isNull() | (F.col("n__") > 1)).isEmpty():
        return docs, id_col
    placed = docs.withColumns({"digest__": F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), "place__": F.monotonically_increasing_id()})
    order = [F.col(id_col).asc_nulls_last(), F.col("digest__"), F.col("place__")]
    placed = placed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(ROW_KEY, F.monotonically_increasing_id())
    return written(placed.select(*docs.columns, ROW_KEY), "row-keys"), ROW_KEY


def bucket_of(id_col: str, buckets: int):
    """crc32 of the id's decimal text modulo buckets; a null id falls in bucket 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % buckets, F.lit(0))
