"""The incremental pass as a stream: append feeds of canonical rows, upserted batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dialogmill.schemas import EVENTS
from dialogmill.sources.archive import write_events


def stream_upsert(spark: SparkSession, feed: str, archive: str, checkpoint: str):
    """Read what is new in the feed (JSON lines of events) and merge it into the archive; running it again changes nothing."""

    def merge(batch: DataFrame, _: int) -> None:
        session = batch.sparkSession
        last = W.partitionBy("id").orderBy(F.col("arrived__").desc(), F.md5(F.to_json(F.struct(*(c for c in batch.columns if c != "arrived__")))))
        rows = batch.withColumn("n__", F.row_number().over(last)).where("n__ = 1").drop("n__", "arrived__")
        try:
            session.read.parquet(archive)
            exists = True
        except Exception as e:  # a new archive has no files yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            exists = False
        write_events(session, rows, archive, exists)

    source = spark.readStream.schema(EVENTS).json(feed).withColumn("arrived__", F.col("_metadata.file_modification_time"))
    return source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
