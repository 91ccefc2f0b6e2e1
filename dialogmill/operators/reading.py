"""Reading sessions: numbered messages, windows around messages, reading as of an instant, text in parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dialogmill.functions.columns import anchor_millis, format_ts, trimmed


def message_index(docs: DataFrame) -> DataFrame:
    """docs without titles, with idx: the place of each message in its session, from 0."""
    order = W.partitionBy("session_id").orderBy("ts", "id")
    return docs.where("role <> 'title'").withColumn("idx", F.row_number().over(order) - 1)


def resolve_anchors(requests: DataFrame, docs: DataFrame) -> DataFrame:
    """requests (req_id, session_id, at) with status and anchor_ts: at is a message of the session, or a time."""
    messages = docs.where("role <> 'title'").select(F.col("id").alias("at"), F.col("session_id").alias("in__"), F.col("ts").alias("ts__"))
    joined = requests.join(messages, "at", "left").withColumn("time__", anchor_millis(F.col("at")))
    sessions = docs.select("session_id").distinct().withColumn("known__", F.lit(True))
    joined = joined.join(sessions, "session_id", "left")
    status = (
        F.when(trimmed(F.coalesce("at", F.lit(""))) == "", "empty").when(F.col("known__").isNull(), "not_found")
        .when(F.col("in__") == F.col("session_id"), "ok").when(F.col("in__").isNotNull(), "other_session").when(F.col("time__").isNotNull(), "ok").otherwise("invalid")
    )
    anchor = F.when(F.col("in__") == F.col("session_id"), F.col("ts__")).otherwise(F.col("time__"))
    return joined.withColumn("status", status).withColumn("anchor_ts", F.when(F.col("status") == "ok", anchor)).select("req_id", "session_id", "at", "status", "anchor_ts")


def read_as_of(anchors: DataFrame, docs: DataFrame) -> DataFrame:
    """(req_id, session_id, idx, id, ts, visible): a message is visible up to and at the anchor's time."""
    numbered = message_index(docs.join(anchors.select("session_id").distinct(), "session_id", "left_semi"))
    return numbered.join(anchors.select("req_id", "session_id", "anchor_ts"), "session_id").select("req_id", "session_id", "idx", "id", "ts", (F.col("anchor_ts").isNull() | (F.col("ts") <= F.col("anchor_ts"))).alias("visible"))


def read_counters(read: DataFrame) -> DataFrame:
    return read.groupBy("req_id", "session_id").agg(F.count("*").alias("total"), F.count_if("visible").alias("visible"), F.count_if(~F.col("visible")).alias("masked"))


def read_sessions(requests: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows and headers for requests (req_id, session_id, around, ctx, tail, at).

    First the anchor masks later messages; then a window around a visible message, else the last `tail` visible ones,
    else all. An unknown message around gives the whole session and a warning, one after the anchor no rows.
    """
    anchored = requests.where("at IS NOT NULL")
    anchors = requests.where("at IS NULL").select("req_id", "session_id", F.lit("ok").alias("status"), F.lit(None).cast("bigint").alias("anchor_ts")).unionByName(resolve_anchors(anchored, docs).drop("at"))
    read = read_as_of(anchors.where("status = 'ok'"), docs)
    counters = read_counters(read)
    asked = requests.select("req_id", "around", F.coalesce("ctx", F.lit(3)).alias("ctx"), "tail")
    center = read.join(asked.where("around IS NOT NULL"), "req_id").where("id = around").select("req_id", F.col("idx").alias("center"), F.col("visible").alias("center_visible"))
    headers = anchors.join(counters.drop("session_id"), "req_id", "left").join(asked, "req_id").join(center, "req_id", "left")
    mode = F.when(F.col("around").isNotNull() & F.col("center").isNotNull(), "around").when(F.col("around").isNotNull(), "all").when(F.col("tail").isNotNull() & (F.col("visible") > F.col("tail")), "tail").otherwise("all")
    warning = F.when(F.col("around").isNotNull() & F.col("center").isNull(), "unknown message").when(~F.col("center_visible"), "message after the anchor")
    headers = headers.withColumns({"mode": mode, "warning": warning})
    chosen = read.where("visible").join(headers.select("req_id", "mode", "center", "center_visible", "ctx", "tail", F.col("visible").alias("n_visible")), "req_id")
    inside = F.when(F.col("mode") == "around", F.col("center_visible") & F.col("idx").between(F.col("center") - F.col("ctx"), F.col("center") + F.col("ctx"))).when(F.col("mode") == "tail", F.col("idx") >= F.col("n_visible") - F.col("tail")).otherwise(True)
    rows = chosen.where(inside).select("req_id", "session_id", "idx", "id", "ts")
    return rows, headers.select("req_id", "session_id", "status", "mode", "total", "visible", "masked", "warning")


def tail(docs: DataFrame, n: int) -> DataFrame:
    """The last n messages of each session."""
    back = W.partitionBy("session_id").orderBy(F.col("ts").desc(), F.col("id").desc())
    return docs.where("role <> 'title'").withColumn("back", F.row_number().over(back)).where(F.col("back") <= n)


def keyset_page(docs: DataFrame, after_ts: int, after_id: str, n: int, until_ts: int | None = None) -> DataFrame:
    """The next n messages after (ts, id), and whether there are more."""
    rest = docs.where("role <> 'title'").where((F.col("ts") > after_ts) | ((F.col("ts") == after_ts) & (F.col("id") > after_id)))
    rest = rest if until_ts is None else rest.where(F.col("ts") <= until_ts)
    ahead = rest.orderBy("ts", "id").limit(n + 1)
    placed = ahead.withColumn("n__", F.row_number().over(W.orderBy("ts", "id"))).withColumn("has_more", F.max("n__").over(W.partitionBy()) > n)  # n + 1 rows
    return placed.where(F.col("n__") <= n).drop("n__")


def merge_windows(spans: DataFrame) -> DataFrame:
    """(req_id, session_id, low, high): overlapping or adjacent spans as one."""
    order = W.partitionBy("req_id", "session_id").orderBy("low", "high")
    reach = F.max("high").over(order.rowsBetween(W.unboundedPreceding, -1))
    island = F.sum(F.when(reach.isNull() | (F.col("low") > F.col("reach__") + 1), 1).otherwise(0)).over(order)
    return spans.withColumn("reach__", reach).withColumn("island", island).groupBy("req_id", "session_id", "island").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def gap_markers(shown: DataFrame, totals: DataFrame) -> DataFrame:
    """shown (req_id, session_id, idx) with gap_before, and gap_after on the last row before the end."""
    order = W.partitionBy("req_id", "session_id").orderBy("idx")
    joined = shown.join(totals, ["req_id", "session_id"])
    before = F.col("idx") > F.coalesce(F.lag("idx").over(order), F.lit(-1)) + 1
    after = F.lead("idx").over(order).isNull() & (F.col("idx") < F.col("total") - 1)
    return joined.withColumns({"gap_before": before, "gap_after": after})


def chunks(df: DataFrame, text_col: str, n: int, *keep: str) -> DataFrame:
    """keep, offset, end, part, complete: the text in parts of n characters, one for an empty text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(n))
    cut = df.select(*keep, text.alias("text__"), F.explode(starts).alias("offset"))
    part = F.substring(F.col("text__"), F.col("offset") + 1, F.lit(n))
    return cut.select(*keep, "offset", (F.col("offset") + F.length(part)).alias("end"), part.alias("part"), (F.length(part) == F.length("text__")).alias("complete"))


def call_chunks(events: DataFrame, n: int) -> DataFrame:
    calls = events.select("id", F.posexplode("toolCalls").alias("call_index", "c")).select("id", "call_index", F.col("c.tool").alias("tool"), F.col("c.cmd").alias("cmd"))
    return chunks(calls, "cmd", n, "id", "call_index", "tool")


def calls_summary(events: DataFrame) -> DataFrame:
    calls = F.coalesce("toolCalls", F.array().cast(events.schema["toolCalls"].dataType))
    sizes = lambda k: F.coalesce(F.array_max(F.transform(calls, lambda c: F.octet_length(F.coalesce(c[k], F.lit(""))))), F.lit(0))
    return events.select("id", F.size(calls).alias("n_calls"), F.aggregate(calls, F.lit(0), lambda s, c: s + F.length(F.coalesce(c["cmd"], F.lit("")))).alias("cmd_chars"), sizes("tool").alias("max_tool_bytes"), sizes("rawRef").alias("max_ref_bytes"))


def events_export(events: DataFrame) -> DataFrame:
    """Messages in order with their calls: what messages_export gives for search rows, from events."""
    numbered = events.withColumn("index", F.row_number().over(W.partitionBy("sessionId").orderBy("ts", "id")) - 1)
    calls = F.coalesce("toolCalls", F.array().cast(events.schema["toolCalls"].dataType))
    return numbered.select(F.col("sessionId").alias("session_id"), "index", "id", "ts", format_ts(F.col("ts")).alias("date"), "role", "agent", "model", "text", calls.alias("toolCalls"))


def messages_export(docs: DataFrame) -> DataFrame:
    return message_index(docs).select("session_id", F.col("idx").alias("index"), format_ts(F.col("ts")).alias("date"), "id", "role", "agent", "model", "text", "cmd")
