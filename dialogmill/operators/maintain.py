"""Keeping archive tables up to date: upserts, state, fingerprints, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dialogmill.operators.normalise import title_rows
from dialogmill.operators.search import rawrefs


def digest(df: DataFrame, *leave: str):
    """One md5 for a row, whatever its columns' order; a null differs from an empty text. Structs count by their JSON."""
    names = sorted(c for c in df.columns if c not in leave)
    nested = {f.name for f in df.schema if f.dataType.simpleString().startswith(("struct", "array", "map"))}
    return F.md5(F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), F.to_json(c) if c in nested else F.col(c).cast("string")), F.lit("-")) for c in names)))


def latest(df: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """The last version of each key by order (ties, and rows without an order: by their digest)."""
    by = [F.col(order).desc()] if order else []
    return df.withColumn("d__", digest(df)).withColumn("n__", F.row_number().over(W.partitionBy(key).orderBy(*by, F.col("d__").desc()))).where("n__ = 1").drop("n__", "d__")


def upsert_status(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """(key, status): added, updated or unchanged for new rows, kept for the others."""
    a = old.select(key, digest(old).alias("old__"))
    b = new.select(key, digest(new.select(*old.columns)).alias("new__"))
    both = a.join(b, key, "full_outer")
    status = F.when(F.col("new__").isNull(), "kept").when(F.col("old__").isNull(), "added").when(F.col("old__") == F.col("new__"), "unchanged").otherwise("updated")
    return both.select(key, status.alias("status"))


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """old with the rows of new in place of those of equal key; nothing is ever removed."""
    once = latest(new.select(*old.columns), key)
    return once.unionByName(old.join(new.select(key), key, "left_anti").select(*old.columns))


def merged(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """What upsert gives, with a status (kept, added, updated, unchanged) for each row, by one join."""
    names = old.columns
    packed = lambda d, name: d.select(F.col(key).alias("key__"), F.struct(*names).alias(name), digest(d.select(*names)).alias(f"{name}_mark"))
    both = packed(old, "before").join(packed(latest(new.select(*names), key), "after"), "key__", "full_outer")
    status = F.when(F.col("after").isNull(), "kept").when(F.col("before").isNull(), "added").when(F.col("before_mark") == F.col("after_mark"), "unchanged").otherwise("updated")
    return both.select(F.coalesce("after", "before").alias("row"), status.alias("status")).select("row.*", "status")


def refresh_titles(docs: DataFrame, touched: DataFrame) -> DataFrame:
    """Search rows after an upsert of sessions: titles of touched sessions are written anew, or go if the title is empty."""
    titles = title_rows(touched)
    kept = docs.join(touched.select(F.col("id")).withColumn("role", F.lit("title")), ["id", "role"], "left_anti")
    return kept.select(*docs.columns).unionByName(titles.select(*docs.columns))


def refresh_rawrefs(refs: DataFrame, touched: DataFrame) -> DataFrame:
    """References after an upsert of events: those of replaced events go before the new ones come; the new one of a reference wins."""
    fresh = rawrefs(touched)
    kept = refs.join(touched.select(F.col("id").alias("event_id")), "event_id", "left_anti").join(fresh.select("raw_ref"), "raw_ref", "left_anti")
    return kept.select(*refs.columns).unionByName(fresh.select(*refs.columns))


def ingest_summary(*kinds: tuple[str, DataFrame]) -> DataFrame:
    """(kind, status, n) of tables with a status, each under its kind: events, sessions, raw outputs, orphans, ignored lines."""
    parts = [status.groupBy("status").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "status", "n") for kind, status in kinds]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found


def advance_state(state: DataFrame, seen: DataFrame, reset: tuple[str, ...] = ()) -> DataFrame:
    """(source, watermark): the largest time of each source; sources that were not seen keep theirs, those in reset start again."""
    return state.where(~F.col("source").isin(*reset)).select("source", "watermark").unionByName(seen.select(F.coalesce("source", F.lit("opencode")).alias("source"), F.col("ts").alias("watermark"))).groupBy("source").agg(F.max("watermark").alias("watermark"))


def table_lag(archive: DataFrame, index: DataFrame) -> DataFrame:
    """(source, state): is the second table equal to, behind, ahead of or else different from the first?"""

    def summed(df: DataFrame, p: str) -> DataFrame:
        rows = F.bit_xor(F.xxhash64("id", F.md5(F.coalesce("text", F.lit("")))))
        return df.groupBy(F.coalesce("source", F.lit("opencode")).alias("source")).agg(F.count("*").alias(f"n_{p}"), F.max("ts").alias(f"ts_{p}"), rows.alias(f"x_{p}"))

    both = summed(archive, "a").join(summed(index, "b"), "source", "full_outer")
    n_a, n_b = F.coalesce("n_a", F.lit(0)), F.coalesce("n_b", F.lit(0))
    state = F.when((n_a == n_b) & (F.col("x_a") == F.col("x_b")), "equal").when(n_b < n_a, "behind").when(n_b > n_a, "ahead").otherwise("differs")
    return both.select("source", n_a.alias("archive_rows"), n_b.alias("index_rows"), state.alias("state"))


def fingerprint(df: DataFrame, key: str = "id") -> DataFrame:
    """One md5 over all rows, whatever their order: of at most 256 md5 sums over the rows of a prefix of the key's md5."""
    rows = df.select(F.substring(F.md5(F.col(key)), 1, 2).alias("p"), digest(df).alias("d"))
    # sums of each prefix do not collect its rows: they add up the parts of the digests
    parts = [F.sum(F.conv(F.substring("d", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(4)]
    prefixes = rows.groupBy("p").agg(F.md5(F.concat_ws(":", F.count("*").cast("string"), *parts)).alias("d"))
    return prefixes.agg(F.md5(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "p", "d"))), "\n")).alias("fingerprint"))


def fingerprint_parts(df: DataFrame, key: str = "id", sign: int = 1) -> DataFrame:
    """(p, n, s0 to s3): number of rows and sums of their digests for each prefix; they add up, so a pass moves them on by what it changes."""
    rows = df.select(F.substring(F.md5(F.col(key)), 1, 2).alias("p"), digest(df).alias("d"))
    number = lambda i: F.conv(F.substring("d", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")
    return rows.groupBy("p").agg((sign * F.count("*")).alias("n"), *((sign * F.sum(number(i))).alias(f"s{i}") for i in range(4)))


def advance_parts(parts: DataFrame, gone: DataFrame, come: DataFrame, key: str = "id") -> DataFrame:
    """parts after rows have gone (in the versions they had) and come; prefixes without a change aren't read."""
    moved = parts.unionByName(fingerprint_parts(gone, key, -1)).unionByName(fingerprint_parts(come, key))
    return moved.groupBy("p").agg(*(F.sum(c).alias(c) for c in ("n", "s0", "s1", "s2", "s3"))).where("n > 0")


def fingerprint_of(parts: DataFrame) -> DataFrame:
    """The fingerprint of the rows that parts stand for."""
    prefixes = parts.select("p", F.md5(F.concat_ws(":", *(F.col(c).cast("string") for c in ("n", "s0", "s1", "s2", "s3")))).alias("d"))
    return prefixes.agg(F.md5(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "p", "d"))), "\n")).alias("fingerprint"))


def file_fingerprint(spark, path: str) -> DataFrame:
    """The same over the files below a folder, by their path and content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(~F.col("path").rlike(r"/[._][^/]*$|\.tmp$"))
    root = path.rstrip("/") + "/"
    name = F.col("path").substr(F.instr("path", root) + len(root), F.length("path"))
    return fingerprint(files.select(name.alias("id"), F.md5("content").alias("md5")))
