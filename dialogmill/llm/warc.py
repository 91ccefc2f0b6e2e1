"""A content-addressed WARC archive.

Payload bytes are stored once for each SHA-256 digest, exact record headers in a table of their own, and the
original records come back through joins: header, blank line, payload, two line ends. The digest of every payload
that is read back is computed again and must equal its address.

Of records with equal payloads of at least min_bytes, the one with the smallest id is a response and the others
are revisits that refer to it. Smaller payloads are always responses.

A record's id holds the row's id and the start of a digest of its target and payload, so a revisit's WARC-Refers-To
names the row that it refers to; refers_to is read from there. A revisit's payload is read and verified as well.

Rows: a null html is an empty payload. A row with null id is written as a response of its own and never referred
to. Rows that repeat an id and a payload are equal records; each of them becomes a response if its id is the
smallest. A null url is written as an empty target; line ends in a target are written as %0D and %0A. An empty table
gives an empty archive. Further columns are not stored.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogmill.llm.common import shared_dir, table


def _payloads(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", **_) -> DataFrame:
    body = F.encode(F.coalesce(F.col(body_col), F.lit("")), "UTF-8")
    return pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), body.alias("payload")).withColumn("digest", F.sha2("payload", 256))


def _record_id(row_id: Column, url: Column, digest: Column) -> Column:
    """<urn:record:ID:MARK>; ID is empty for null."""
    mark = F.substring(F.sha2(F.concat(url, F.lit(" "), digest), 256), 1, 16)
    return F.concat(F.lit("<urn:record:"), F.coalesce(F.url_encode(row_id.cast("string")), F.lit("")), F.lit(":"), mark, F.lit(">"))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_bytes: int = 100, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """id, header, digest: all of a record but its payload; large: a response whose payload others may refer to."""
    base = _payloads(pages, id_col, url_col, body_col).select("id", "url", "digest", F.octet_length("payload").cast("bigint").alias("n_bytes"))
    # aggregated before the shuffle: a payload of many records costs one row for each task
    first = base.where(F.col("n_bytes") >= min_bytes).where("id IS NOT NULL").groupBy("digest").agg(F.min(F.struct("id", "url")).alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    joined = base.join(first, "digest", "left").withColumn("first", F.when(F.col("first.id") < F.col("id"), F.col("first")))
    revisit = F.col("first").isNotNull()
    eol = "\r\n"
    target = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    header = F.concat(
        F.lit(f"WARC/1.1{eol}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{eol}WARC-Record-ID: "), _record_id(F.col("id"), F.col("url"), F.col("digest")),
        F.lit(f"{eol}WARC-Date: {date}{eol}WARC-Target-URI: "), target,
        F.lit(f"{eol}WARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"{eol}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{eol}WARC-Refers-To: "), _record_id(F.col("first.id"), F.col("first.url"), F.col("digest")))).otherwise(""),
        F.lit(f"{eol}Content-Type: text/html; charset=utf-8{eol}Content-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("n_bytes").cast("string")),
        F.lit(eol + eol),
    )
    return joined.select("id", header.alias("header"), "digest", (~revisit & F.col("id").isNotNull() & (F.col("n_bytes") >= min_bytes)).alias("large"))


def _table(path: str, name: str) -> str:
    return f"warc_{name}_{hashlib.md5(path.encode()).hexdigest()[:16]}"


def write_archive(pages: DataFrame, path: str, **options) -> None:
    """Parquet tables: payloads(digest, payload), each digest once, and headers(id, header, digest) in two parts.

    Payloads and the headers of the responses that stand for them (large) lie in buckets of their digest, so records
    are put together without moving payloads again. Revisits and small responses, whose digests may be very
    frequent, are apart (other): their join moves no more than lengths and small payloads.
    """
    spark = pages.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = records(pages, **options)
    found.where("NOT large").drop("large").write.parquet(f"{path}/headers/other")
    bucketed = lambda df, name: df.write.bucketBy(buckets, "digest").sortBy("digest").option("path", f"{path}/{name}").saveAsTable(_table(path, name.replace("/", "_")), format="parquet")
    bucketed(found.where("large").drop("large"), "headers/large")
    bucketed(_payloads(pages, **options).groupBy("digest").agg(F.first("payload").alias("payload")), "payloads")


def _stored(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A bucketed table of this session's catalogue, or just its files: then records are put together with a shuffle."""
    table_name = _table(path, name.replace("/", "_"))
    return spark.table(table_name) if spark.catalog.tableExists(table_name) else spark.read.parquet(f"{path}/{name}")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """id, record (the exact bytes), record_type, payload (null for revisits), payload_digest, payload_bytes, refers_to.

    The digest of each stored payload is verified, that of revisits too; a wrong or missing payload raises an error.
    Revisits take only the length of their payload through the join.
    """
    stored = _stored(spark, path, "payloads")
    good = F.sha2("payload", 256) == F.col("digest")
    wrong = F.raise_error(F.concat(F.lit("payload doesn't match its digest "), "digest"))
    checked = stored.select("digest", F.when(good, F.col("payload")).otherwise(wrong.cast("binary")).alias("payload"))
    sizes = checked.select("digest", F.octet_length("payload").cast("bigint").alias("payload_bytes"))
    head, ends = F.encode("header", "UTF-8"), F.encode(F.lit("\r\n\r\n"), "UTF-8")

    def parts(headers: DataFrame) -> DataFrame:
        header = F.col("header")
        return headers.select(
            "id", "header", "digest", F.regexp_extract(header, r"\r\nWARC-Refers-To: <urn:record:([^:>]*):[0-9a-f]{16}>\r\n", 1).alias("refers"),
            F.regexp_extract(header, r"\r\nWARC-Type: (\w+)\r\n", 1).alias("record_type"), F.regexp_extract(header, r"\r\nWARC-Payload-Digest: sha256:([0-9a-f]{64})\r\n", 1).alias("payload_digest"),
            F.regexp_extract(header, r"\r\nContent-Length: (\d+)\r\n", 1).cast("bigint").alias("said"),
        )

    def rebuilt(responses: DataFrame, payloads: DataFrame) -> DataFrame:
        whole = responses.join(payloads, "digest", "left").withColumn("record", F.concat(head, "payload", ends))
        whole = whole.withColumn("payload_bytes", (F.octet_length("record") - F.octet_length("header") - 4).cast("bigint"))
        return whole.withColumn("payload_bytes", F.when((F.col("payload_bytes") == F.col("said")) & (F.col("digest") == F.col("payload_digest")), F.col("payload_bytes")))

    large, other = parts(_stored(spark, path, "headers/large")), parts(spark.read.parquet(f"{path}/headers/other"))
    small = other.where("record_type = 'response'")
    few = checked.join(small.select("digest").distinct(), "digest", "left_semi")
    again = other.where("record_type = 'revisit'").join(sizes, "digest", "left").withColumns({"record": F.concat(head, ends), "payload": F.lit(None).cast("binary")})
    both = rebuilt(large, checked).unionByName(rebuilt(small, few)).unionByName(again, allowMissingColumns=True)
    missing = F.raise_error(F.concat(F.lit("no whole payload for "), "payload_digest"))
    return both.select(
        "id", "record", "record_type", "payload", "payload_digest",
        F.when(F.col("payload_bytes").isNotNull(), F.col("payload_bytes")).otherwise(missing.cast("bigint")).alias("payload_bytes"),
        F.when(F.col("refers") != "", F.url_decode("refers")).cast(other.schema["id"].dataType).alias("refers_to"),
    )


def op9_warc(spark, sf_dir):
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    back = read_archive(spark, path)
    return back.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
     f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM f
"""
