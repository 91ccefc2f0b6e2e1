"""Relational session records (session, message, part rows with JSON data) to canonical sessions and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogmill.functions.columns import cmd_of, exit_code_of, model_name, model_of, raw_content_of, repo_of, search_cmd, source_of, tokens_of, variant_string, variant_text

_COUNTS = ["in", "out", "reasoning", "cacheRead", "cacheWrite"]


def canonical_sessions(session: DataFrame, home: str | None = None) -> DataFrame:
    n = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint"))
    tokens = F.struct(n("tokens_input").alias("in"), n("tokens_output").alias("out"), n("tokens_reasoning").alias("reasoning"), n("tokens_cache_read").alias("cacheRead"), n("tokens_cache_write").alias("cacheWrite"))
    return session.select(
        F.lit(1).alias("schemaVersion"), F.lit("opencode").alias("source"), "id", "title", "directory", repo_of(F.col("directory"), home).alias("repo"),
        F.col("time_created").alias("tsCreated"), F.col("time_updated").alias("tsUpdated"), F.coalesce("cost", F.lit(0.0)).alias("cost"), tokens.alias("tokens"), F.col("parent_id").alias("parentSession"),
    )


def _parsed(part: DataFrame) -> DataFrame:
    """Parts whose data is JSON."""
    return part.withColumn("v", F.try_parse_json("data")).where("v IS NOT NULL")


def raw_outputs(part: DataFrame) -> DataFrame:
    tools = _parsed(part).where(variant_text(F.col("v"), "$.type") == "tool")
    return tools.select(F.col("id").alias("part_id"), raw_content_of(F.col("v")).alias("content"), F.lit("opencode").alias("source")).where("content IS NOT NULL")


def canonical_events(message: DataFrame, part: DataFrame, session: DataFrame, home: str | None = None) -> DataFrame:
    """One event for each user or assistant message, with its text, calls and usage from its parts in order of their ids.

    Where tokens or cost are missing in the message, the sums of its finished steps are added to what is there.
    """
    v = F.col("v")
    kind = variant_text(v, "$.type")
    parts = _parsed(part.join(message.select(F.col("id").alias("message_id")), "message_id", "left_semi"))
    text = F.when((kind == "text") & (variant_string(v, "$.text") != ""), variant_string(v, "$.text"))
    call = F.when(
        kind == "tool",
        F.struct(variant_text(v, "$.tool").alias("tool"), cmd_of(v, "$.state.input").alias("cmd"), exit_code_of(v).alias("exitCode"), F.when(raw_content_of(v).isNotNull(), F.col("id")).alias("rawRef")),
    )
    step = kind == "step-finish"
    usage = tokens_of(v, "$.tokens")
    rows = parts.select("message_id", F.col("id").alias("part_id"), text.alias("t"), call.alias("c"), F.when(step, usage).alias("u"), F.when(step, F.coalesce(F.try_variant_get(v, "$.cost", "double"), F.lit(0.0))).alias("k"))
    by_id = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("part_id", c)))), lambda x: x[c])
    grouped = rows.groupBy("message_id").agg(
        by_id("t").alias("texts"), by_id("c").alias("calls"), F.sum("k").alias("step_cost"),
        *(F.sum(F.col("u")[n]).alias(f"step_{n}") for n in _COUNTS),
    )
    parsed = message.withColumn("v", F.try_parse_json("data")).where("v IS NOT NULL").where(variant_text(v, "$.role").isin("user", "assistant"))
    repos = session.select(F.col("id").alias("session_id"), repo_of(F.col("directory"), home).alias("repo"))
    joined = parsed.join(grouped, parsed["id"] == grouped["message_id"], "left").join(repos, "session_id", "left")
    has_tokens = F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.tokens", "variant")).startswith("OBJECT"), F.lit(False))
    cost = F.try_variant_get(v, "$.cost", "double")
    add = ~has_tokens | cost.isNull()
    own = tokens_of(v, "$.tokens")
    step_of = lambda n: F.when(add, F.coalesce(F.col(f"step_{n}"), F.lit(0))).otherwise(0)
    tokens = F.struct(*((own[n] + step_of(n)).alias(n) for n in _COUNTS))
    return joined.select(
        F.lit(1).alias("schemaVersion"), F.lit("opencode").alias("source"), parsed["id"], F.col("session_id").alias("sessionId"), F.col("time_created").alias("ts"), variant_text(v, "$.role").alias("role"),
        F.when(F.size("texts") > 0, F.array_join("texts", "\n\n")).alias("text"), model_of(v).alias("model"), variant_text(v, "$.agent").alias("agent"), "repo", tokens.alias("tokens"),
        (F.coalesce(cost, F.lit(0.0)) + F.when(add, F.coalesce("step_cost", F.lit(0.0))).otherwise(0.0)).alias("cost"), F.when(F.size("calls") > 0, F.col("calls")).alias("toolCalls"),
    )


def search_docs(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Events and titles as rows to search."""
    messages = events.select("id", F.col("sessionId").alias("session_id"), "ts", "role", "agent", "repo", model_name(F.col("model")).alias("model"), F.coalesce(search_cmd(F.col("toolCalls")), F.lit("")).alias("cmd"), F.coalesce("text", F.lit("")).alias("text"), source_of().alias("source"))
    return messages.unionByName(title_rows(sessions))


def title_rows(sessions: DataFrame) -> DataFrame:
    """Titles that aren't empty, as rows to search; a session's time is its first, else its last, else 0."""
    return sessions.where("title <> ''").select("id", F.col("id").alias("session_id"), F.coalesce("tsCreated", "tsUpdated", F.lit(0)).alias("ts"), F.lit("title").alias("role"), F.lit(None).cast("string").alias("agent"), "repo", F.lit(None).cast("string").alias("model"), F.lit("").alias("cmd"), F.col("title").alias("text"), source_of().alias("source"))
