"""Statistics of sources and models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogmill.functions.columns import exit_code_of
from dialogmill.operators.search import ref_source


def source_status(docs: DataFrame, sessions: DataFrame, state: DataFrame | None = None, refs: DataFrame | None = None) -> DataFrame:
    """(source, sessions, events, raw_refs, watermark); titles are no events."""
    source = F.coalesce("source", F.lit("opencode")).alias("source")
    events = docs.where("role <> 'title'").groupBy(source).agg(F.count("*").alias("events"), F.max("ts").alias("watermark"))
    both = sessions.groupBy(source).agg(F.count("*").alias("sessions")).join(events, "source", "full_outer")
    if state is not None:
        both = both.drop("watermark").join(state.select("source", "watermark"), "source", "full_outer")
    if refs is not None:
        both = both.join(refs.groupBy(ref_source(F.col("raw_ref")).alias("source")).agg(F.count("*").alias("raw_refs")), "source", "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return both.select("source", zero("sessions"), zero("events"), *([zero("raw_refs")] if refs is not None else []), "watermark")


def model_cost_summary(events: DataFrame) -> DataFrame:
    """(model, messages, cost, tokens_in, tokens_out), most expensive first."""
    return events.groupBy(F.coalesce("model", F.lit("?")).alias("model")).agg(F.count("*").alias("messages"), F.sum("cost").alias("cost"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out")).orderBy(F.col("cost").desc(), "model")


def source_profile(calls: DataFrame, top: int = 12) -> DataFrame:
    """(tool, n, sessions, with_cmd): the most used tools."""
    return calls.groupBy("tool").agg(F.count("*").alias("n"), F.countDistinct("session_id").alias("sessions"), F.count_if(F.col("cmd") != "").alias("with_cmd")).orderBy(F.col("n").desc(), "tool").limit(top)


def role_counts(message: DataFrame) -> DataFrame:
    """(role, n) of message rows with JSON data."""
    return message.groupBy(F.coalesce(F.try_variant_get(F.try_parse_json("data"), "$.role", "string"), F.lit("?")).alias("role")).agg(F.count("*").alias("n"))


def part_profile(part: DataFrame) -> DataFrame:
    """(type, n, with_state, with_output, with_exit, key_sets) of part rows with JSON data; key_sets are sets of names of state's fields."""
    v = part.withColumn("v", F.try_parse_json("data")).where("v IS NOT NULL")
    get = lambda p: F.try_variant_get("v", p, "string")
    keys = F.array_join(F.array_sort(F.json_object_keys(F.get_json_object("data", "$.state"))), ",")
    return v.groupBy(get("$.type").alias("type")).agg(
        F.count("*").alias("n"), F.count_if(F.get_json_object("data", "$.state").isNotNull()).alias("with_state"), F.count_if(F.coalesce(get("$.state.output"), F.lit("")) != "").alias("with_output"),
        F.count_if(exit_code_of(F.col("v")).isNotNull()).alias("with_exit"), F.array_join(F.array_sort(F.collect_set(keys)), ";").alias("key_sets"),
    )


def busy_messages(part: DataFrame, top: int = 5) -> DataFrame:
    """Messages with more than one tool call."""
    tools = part.withColumn("v", F.try_parse_json("data")).where(F.try_variant_get("v", "$.type", "string") == "tool")
    return tools.groupBy("message_id").agg(F.count("*").alias("calls")).where("calls > 1").orderBy(F.col("calls").desc(), "message_id").limit(top)
