"""Session, message and part tables of a relational source, as Parquet or JSON extracts or by JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Ranges of time_updated in which a table is read by JDBC, each in a task and a connection of its own.
PARTS = 16


def _table(spark: SparkSession, path: str, name: str, jdbc: dict | None, parts: int = PARTS) -> DataFrame:
    """An extract, or a table by JDBC in ranges of its update time; conditions on it reach the database."""
    if not jdbc:
        return spark.read.parquet(f"{path}/{name}.parquet")
    time = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(jdbc["url"]).quoteIdentifier("time_updated")
    low, high = spark.read.format("jdbc").options(**jdbc, query=f"SELECT min({time}) AS low, max({time}) AS high FROM {name}").load().first()
    reader = spark.read.format("jdbc").options(**jdbc, dbtable=name)
    if low is None or low == high:
        return reader.load()
    return reader.options(partitionColumn="time_updated", lowerBound=low, upperBound=high + 1, numPartitions=min(parts, high - low + 1)).load()


def _since(df: DataFrame, watermark: int | None, inclusive: bool) -> DataFrame:
    if watermark is None:
        return df
    return df.where(F.col("time_updated") >= watermark if inclusive else F.col("time_updated") > watermark)


def read_sessions(spark: SparkSession, path: str, watermark: int | None = None, inclusive: bool = False, jdbc: dict | None = None) -> DataFrame:
    """Rows changed since the watermark; the condition reaches the scan. inclusive is safe, as upserts are idempotent."""
    return _since(_table(spark, path, "session", jdbc), watermark, inclusive)


def read_messages(spark: SparkSession, path: str, watermark: int | None = None, inclusive: bool = False, jdbc: dict | None = None) -> DataFrame:
    return _since(_table(spark, path, "message", jdbc), watermark, inclusive)


def read_parts(spark: SparkSession, path: str, messages: DataFrame, jdbc: dict | None = None) -> DataFrame:
    """Parts of the messages, without those whose data is no JSON."""
    parts = _table(spark, path, "part", jdbc).join(messages.select(F.col("id").alias("message_id")), "message_id", "left_semi")
    return parts.where(F.try_parse_json("data").isNotNull())
