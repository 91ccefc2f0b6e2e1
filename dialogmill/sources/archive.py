"""The canonical archive: events, sessions and raw outputs, dealt out by a prefix of the md5 of their key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from dialogmill.operators.maintain import latest, merged
from dialogmill.schemas import EVENTS, SESSIONS
from dialogmill.sources.ranges import located
from dialogmill.sources.staging import staged


def prefix(key: str):
    return F.substring(F.md5(F.col(key)), 1, 2)


def read_archive(spark: SparkSession, path: str, schema: str = EVENTS, legacy: bool = False) -> DataFrame:
    """The archive's rows; in the legacy JSON layout, lines that are no rows are left out."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED") if legacy else spark.read.parquet(path)


def write_partitioned(df: DataFrame, path: str, key: str, *order: str) -> None:
    """Only the prefixes that df has are replaced, so df must hold all rows of these. Any number of tasks writes a prefix."""
    rows = df.withColumn("p", prefix(key)).repartitionByRange("p", *order).sortWithinPartitions("p", *order)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("p").parquet(path)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """An archive's rows with p as text; where all prefixes are digits, Spark would take them for numbers."""
    found = spark.read.parquet(path)
    return spark.read.schema(StructType([StructField("p", StringType()) if f.name == "p" else f for f in found.schema])).parquet(path)


def _touched(spark: SparkSession, new: DataFrame, path: str, key: str, id_col: str) -> list[str]:
    """Prefixes of the new rows and of the rows that they replace: 256 at most. Only ids are read of the archive."""
    moved = _stored(spark, path).select("p", id_col).join(new.select(id_col), id_col, "left_semi").select("p")
    return sorted(r.p for r in new.select(prefix(key).alias("p")).unionByName(moved).distinct().collect())


def write_rows(spark: SparkSession, new: DataFrame, path: str, key: str, id_col: str, *order: str, exists: bool = True) -> dict[str, int]:
    """Upsert by id_col; the prefixes touched are read by name and written again, also where a row moves between them.

    Gives how many rows were added, updated and unchanged, as observed by the write itself.
    """
    seen = Observation()
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("added", "updated", "unchanged")]
    if not exists:
        rows = staged(latest(new, id_col).withColumn("status", F.lit("added")).observe(seen, *counts).drop("status"))
        write_partitioned(rows, path, key, *order)
        return seen.get
    touched = _touched(spark, new, path, key, id_col)
    old = _stored(spark, path).where(F.col("p").isin(touched)).drop("p")
    rows = staged(merged(old, new, id_col).observe(seen, *counts).drop("status"))
    write_partitioned(rows, path, key, *order)
    # prefixes whose last row has moved away go last: a failure before that leaves a row twice, never none
    left = {r.p for r in rows.select(prefix(key).alias("p")).distinct().collect()}
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for p in touched:
        if p not in left:
            gone = hadoop(f"{path}/p={p}")
            gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
    return seen.get


def write_events(spark: SparkSession, new: DataFrame, path: str, exists: bool = True) -> dict[str, int]:
    """Upsert by id, in order of session, time and id."""
    return write_rows(spark, new, path, "sessionId", "id", "sessionId", "ts", "id", exists=exists)


def write_sessions(spark: SparkSession, new: DataFrame, path: str, exists: bool = True) -> dict[str, int]:
    return write_rows(spark, new, path, "id", "id", "id", exists=exists)


def changed_raw(old: DataFrame, new: DataFrame) -> DataFrame:
    """Outputs whose content is new or differs."""
    keyed = lambda d: d.withColumn("md5__", F.md5("content"))
    return keyed(new).join(keyed(old).select("part_id", "md5__"), ["part_id", "md5__"], "left_anti").drop("md5__")


def write_raw(spark: SparkSession, new: DataFrame, path: str, exists: bool = True) -> dict[str, int]:
    """Upsert of raw outputs by part_id; only prefixes with a changed content are written."""
    changed = staged(changed_raw(spark.read.parquet(path), new)) if exists else new
    if exists and changed.isEmpty():
        return {"added": 0, "updated": 0, "unchanged": 0}
    return write_rows(spark, changed, path, "part_id", "part_id", "part_id", exists=exists)


def flat_raw(spark: SparkSession, folder: str) -> DataFrame:
    """(part_id, content, source) of raw outputs in the flat layout: a file NAME.txt for each in one folder.

    Spark lists the files; tasks open them by Arrow's file systems, as Hadoop's can't open names with colons.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder).select("path", "length")
    files = staged(files, "flat-files")
    tasks = max(1, min(files.count() // 1000, 100_000))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, inner = located(path)
                with system.open_input_file(inner) as f:
                    text = f.read().decode("utf-8", "replace")
                yield pa.RecordBatch.from_arrays([pa.array([inner.rsplit("/", 1)[1].removesuffix(".txt")]), pa.array([text], pa.string())], names=["part_id", "content"])

    found = files.select("path").repartition(tasks).mapInArrow(run, "part_id string, content string")
    return found.withColumn("source", F.when(F.col("part_id").startswith("pi:"), "pi").otherwise("opencode"))


def migrate_raw(spark: SparkSession, folder: str, path: str, exists: bool = False) -> DataFrame:
    """Flat raw outputs in the partitioned table; (before, after, written). The files stay; a second run writes nothing."""
    flat = staged(flat_raw(spark, folder), "flat-raw")
    done = write_raw(spark, flat, path, exists)
    after = _stored(spark, path).join(flat.select("part_id"), "part_id", "left_semi").agg(F.count("*").alias("after"))
    return flat.agg(F.count("*").alias("before")).join(after).withColumn("written", F.lit(done["added"] + done["updated"]))  # single rows


def migrate(spark: SparkSession, legacy_events: str, legacy_sessions: str, path: str) -> DataFrame:
    """The single-file layout in the partitioned one; returns counts. Running it again gives the same tables.

    (events_before, events_after, bad_lines, empty_sessions, coherent)
    """
    raw = spark.read.schema(EVENTS + ", _corrupt_record string").json(legacy_events, mode="PERMISSIVE")
    raw = staged(raw)
    good = raw.where("_corrupt_record IS NULL AND id IS NOT NULL").drop("_corrupt_record")
    sessions = spark.read.schema(SESSIONS).json(legacy_sessions, mode="DROPMALFORMED")
    write_partitioned(good, f"{path}/events", "sessionId", "sessionId", "ts", "id")
    write_partitioned(sessions, f"{path}/sessions", "id", "id")
    after = spark.read.parquet(f"{path}/events")
    empty = spark.read.parquet(f"{path}/sessions").join(after.select(F.col("sessionId").alias("id")), "id", "left_anti")
    counts = raw.agg(F.count_if(F.expr("_corrupt_record IS NULL AND id IS NOT NULL")).alias("events_before"), F.count_if(F.col("_corrupt_record").isNotNull()).alias("bad_lines"))
    joined = counts.join(after.agg(F.count("*").alias("events_after"))).join(empty.agg(F.count("*").alias("empty_sessions")))  # single rows
    return joined.withColumn("coherent", F.col("events_before") == F.col("events_after"))
