"""Directories of append-only JSONL session files, to canonical sessions, events and raw outputs.

A file is one session. Lines are read by byte ranges (sources.ranges), and only up to the last line end; what follows is
left to a later pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dialogmill.functions.columns import cmd_of, iso_millis, repo_of, tokens_of, trimmed, unsafe_id, variant_text
from dialogmill.sources.ranges import new_lines
from dialogmill.sources.staging import staged

V = "v"
_COUNTS = ["in", "out", "reasoning", "cacheRead", "cacheWrite"]


def discover(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, mtime) of the session files below path, without hidden names and artifacts of sub-agents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime")).where(~F.col("path").rlike(r"/\.[^/]|/subagent-artifacts/"))


def changed_files(listing: DataFrame, state: DataFrame) -> DataFrame:
    """Files that are new or differ in size or time; a state row without a uuid is read again."""
    return listing.join(state.where("uuid IS NOT NULL").select("path", "size", "mtime"), ["path", "size", "mtime"], "left_anti")


def advance_files(listing: DataFrame, state: DataFrame, read: DataFrame) -> DataFrame:
    """(path, size, mtime, uuid) after a pass: all present files, with the uuid just read (path, uuid), else the known one.

    Files that have vanished leave the state; their events stay in the archive.
    """
    known = state.select("path", F.col("uuid").alias("known__"))
    found = listing.select("path", "size", "mtime").join(read.select("path", "uuid"), "path", "left").join(known, "path", "left")
    return found.select("path", "size", "mtime", F.coalesce("uuid", "known__").alias("uuid"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line) of the terminated lines of the session files below path, from 1; large files in many tasks."""
    return new_lines(discover(spark, path))[0].drop("begin")


def parsed(lines: DataFrame) -> DataFrame:
    return lines.withColumn("v", F.try_parse_json("line"))


def problems(lines: DataFrame) -> DataFrame:
    """(path, line_no, problem): what must stop a pass before anything is written."""
    v = parsed(lines)
    kind = variant_text(V, "$.type")
    bad = v.where((trimmed(F.col("line")) == "") | F.isnull(V)).select("path", "line_no", F.lit("no JSON").alias("problem"))
    head = v.where("line_no = 1 AND v IS NOT NULL")
    good = ((kind == "session") & ~unsafe_id(variant_text(V, "$.id")) & iso_millis(variant_text(V, "$.timestamp")).isNotNull()) | (kind == "session_info")
    headers = head.where(~F.coalesce(good, F.lit(False))).select("path", "line_no", F.lit("no session header").alias("problem"))
    ids = v.where((kind == "message") & variant_text(V, "$.id").isNotNull()).select("path", "line_no", variant_text(V, "$.id").alias("local"))
    names = ids.where(unsafe_id(F.col("local"))).select("path", "line_no", F.lit("unsafe id").alias("problem"))
    twice = ids.groupBy("path", "local").agg(F.max("line_no").alias("line_no"), F.count("*").alias("n")).where("n > 1").select("path", "line_no", F.lit("id used twice").alias("problem"))
    times = v.where((kind == "message") & variant_text(V, "$.message.role").isin("user", "assistant") & _ts().isNull()).select("path", "line_no", F.lit("no time").alias("problem"))
    return bad.unionByName(headers).unionByName(names).unionByName(twice).unionByName(times)


def shared_uuids(files: DataFrame) -> DataFrame:
    """Session ids that two files have, of files (path, uuid) just read and those in the state."""
    return files.where("uuid IS NOT NULL").groupBy("uuid").agg(F.countDistinct("path").alias("files")).where("files > 1")


def headers(lines: DataFrame) -> DataFrame:
    first = parsed(lines.where("line_no = 1")).where(variant_text(V, "$.type") == "session")
    return first.select("path", variant_text(V, "$.id").alias("uuid"), variant_text(V, "$.cwd").alias("cwd"), iso_millis(variant_text(V, "$.timestamp")).alias("ts_created"))


def _ts():
    return F.coalesce(F.try_variant_get(V, "$.message.timestamp", "bigint"), iso_millis(variant_text(V, "$.timestamp")))


def messages(lines: DataFrame) -> DataFrame:
    """(path, uuid, line_no, id, ts, role, content, v) of all message lines."""
    found = parsed(lines).where(variant_text(V, "$.type") == "message").join(headers(lines).select("path", "uuid"), "path")
    local = F.coalesce(variant_text(V, "$.id"), F.concat(F.lit("line-"), F.col("line_no").cast("string")))
    return found.select("path", "uuid", "line_no", F.concat_ws(":", F.lit("pi"), "uuid", local).alias("id"), _ts().alias("ts"), variant_text(V, "$.message.role").alias("role"), F.try_variant_get(V, "$.message.content", "array<variant>").alias("content"), "v")


def _texts(content):
    texts = F.filter(F.transform(content, lambda c: F.when(F.try_variant_get(c, "$.type", "string") == "text", F.try_variant_get(c, "$.text", "string"))), lambda x: x != "")
    return F.when(F.size(texts) > 0, F.array_join(texts, "\n\n"))


def calls(msgs: DataFrame) -> DataFrame:
    """(path, line_no, k, call_id, tool, cmd) of the calls of assistant messages."""
    items = msgs.where("role = 'assistant'").select("path", "uuid", "line_no", F.posexplode("content").alias("k", "c")).where(F.try_variant_get("c", "$.type", "string") == "toolCall")
    c = F.col("c")
    return items.select("path", "uuid", "line_no", "k", F.try_variant_get(c, "$.id", "string").alias("call_id"), F.try_variant_get(c, "$.name", "string").alias("tool"), cmd_of(c, "$.arguments").alias("cmd"))


def results(msgs: DataFrame) -> DataFrame:
    return msgs.where("role = 'toolResult'").select("path", "line_no", "id", variant_text(V, "$.message.toolCallId").alias("call_id"), F.try_variant_get(V, "$.message.exitCode", "int").alias("exit_code"), _texts(F.col("content")).alias("output"))


def bash_runs(msgs: DataFrame) -> DataFrame:
    return msgs.where("role = 'bashExecution'").select("path", "line_no", "id", F.try_variant_get(V, "$.message.exitCode", "int").alias("exit_code"), variant_text(V, "$.message.output").alias("output"))


def attach_results(called: DataFrame, found: DataFrame) -> DataFrame:
    """Each call with an id, and the first result of that id at a later line of its file."""
    ids = called.where("call_id IS NOT NULL").select("path", "line_no", "k", "call_id")
    met = ids.join(found.select("path", "call_id", F.col("line_no").alias("result_line")), ["path", "call_id"]).where("result_line > line_no")
    order = W.partitionBy("path", "call_id").orderBy("result_line", "line_no", "k")
    return met.withColumn("n__", F.row_number().over(order)).where("n__ = 1").select("path", "line_no", "k", "call_id", "result_line")


def attach_bash(called: DataFrame, runs: DataFrame, found: DataFrame) -> DataFrame:
    """(path, call_id, bash_line): each run goes to the open bash call that began last.

    A call opens, a result closes the calls of its id, a run closes the one that opened last and is its own. The calls,
    results and runs of a file, a few bytes each, are sorted by line and streamed past a stack of the open calls, in
    time in proportion to their number. A run's pair is dropped where a result of that call comes later: an equi-join.
    """
    row = lambda kind, call, k: [F.lit(kind).alias("kind"), call.cast("string").alias("call_id"), k.cast("int").alias("k")]
    opens = called.where("tool = 'bash' AND call_id IS NOT NULL").select("path", "line_no", *row(0, F.col("call_id"), F.col("k")))
    closes = found.where("call_id IS NOT NULL").select("path", "line_no", *row(1, F.col("call_id"), F.lit(0)))
    takes = runs.select("path", "line_no", *row(2, F.lit(None), F.lit(0)))
    steps = opens.unionByName(closes).unionByName(takes).select("path", F.col("line_no").cast("bigint").alias("line_no"), "k", "kind", "call_id")
    # numbered by a window, which asks for a file's rows in one task: Spark leaves a repartition of the union out, as its parts
    # are dealt by path already, and then merges partitions of each part by itself
    ordered = steps.withColumn("step", F.row_number().over(W.partitionBy("path").orderBy("line_no", "k", "kind", "call_id")))
    pairs = ordered.mapInArrow(_match, "path string, call_id string, bash_line bigint")
    later = closes.select("path", "call_id", F.col("line_no").alias("result_line"))
    displaced = pairs.join(later, ["path", "call_id"]).where("result_line > bash_line").select("path", "call_id", "bash_line").distinct()
    return pairs.join(displaced, ["path", "call_id", "bash_line"], "left_anti")


def _match(batches):
    """The task of attach_bash, over rows (path, line_no, k, kind, call_id, step) sorted by path and step."""
    import pyarrow as pa

    path, stack, by_id = None, [], {}
    for batch in batches:
        out = []
        for here, line, _, kind, call, _ in zip(*(c.to_pylist() for c in batch.columns)):
            if here != path:
                path, stack, by_id = here, [], {}
            if kind == 0:
                entry = [call, True]
                stack.append(entry)
                by_id.setdefault(call, []).append(entry)
            elif kind == 1:
                for entry in by_id.pop(call, ()):
                    entry[1] = False
            else:
                while stack and not stack[-1][1]:
                    stack.pop()
                if stack:
                    entry = stack.pop()
                    by_id[entry[0]].pop()  # the last one of its id
                    out.append((path, entry[0], line))
        columns = list(zip(*out)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))], names=["path", "call_id", "bash_line"])


def orphans(msgs: DataFrame) -> DataFrame:
    """(path, line_no, id, kind, output): results and runs that belong to no call; never referred to by an event."""
    called, found, runs = calls(msgs), results(msgs), bash_runs(msgs)
    attached = attach_results(called, found).select("path", F.col("result_line").alias("line_no"))
    paired = attach_bash(called, runs, found).select("path", F.col("bash_line").alias("line_no"))
    lone = found.join(attached, ["path", "line_no"], "left_anti").select("path", "line_no", "id", F.lit("result").alias("kind"), "output")
    return lone.unionByName(runs.join(paired, ["path", "line_no"], "left_anti").select("path", "line_no", "id", F.lit("bash").alias("kind"), "output"))


def calls_without_proof(msgs: DataFrame) -> DataFrame:
    """(path, n): shell calls of a file that have neither a result nor a run at its end."""
    called, found, runs = calls(msgs), results(msgs), bash_runs(msgs)
    bash = called.where("tool = 'bash' AND call_id IS NOT NULL")
    done = attach_results(called, found).select("path", "call_id").unionByName(attach_bash(called, runs, found).select("path", "call_id"))
    return bash.join(done, ["path", "call_id"], "left_anti").groupBy("path").agg(F.count("*").alias("n"))


def proofs(msgs: DataFrame) -> DataFrame:
    """(path, line_no, k, ref, exit_code, output) of the calls that have a result or a run."""
    called, found, runs = calls(msgs), results(msgs), bash_runs(msgs)
    by_result = attach_results(called, found).join(found.select("path", F.col("line_no").alias("result_line"), F.col("id").alias("ref"), "exit_code", "output"), ["path", "result_line"]).select("path", "line_no", "k", "ref", "exit_code", "output")
    by_bash = attach_bash(called, runs, found).join(called.select("path", "line_no", "k", "call_id"), ["path", "call_id"]).join(runs.select("path", F.col("line_no").alias("bash_line"), F.col("id").alias("ref"), "exit_code", "output"), ["path", "bash_line"]).select("path", "line_no", "k", "ref", "exit_code", "output")
    return by_result.unionByName(by_bash)


def events(lines: DataFrame) -> DataFrame:
    """Canonical events; messages are parsed once and written, as their calls, results and runs are read several times."""
    msgs = staged(messages(lines), "messages")
    return assembled(msgs, proofs(msgs), headers(lines))


def assembled(msgs: DataFrame, proved: DataFrame, heads: DataFrame) -> DataFrame:
    """Canonical events of messages, the proofs of their calls (path, line_no, k, ref, exit_code, output) and the headers of their files."""
    shown = calls(msgs).join(proved, ["path", "line_no", "k"], "left")
    ref = F.when(F.coalesce("output", F.lit("")) != "", F.col("ref"))
    listed = shown.groupBy("path", "line_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "tool", "cmd", F.col("exit_code").alias("exitCode"), ref.alias("rawRef")))), lambda x: F.struct(x["tool"].alias("tool"), x["cmd"].alias("cmd"), x["exitCode"].alias("exitCode"), x["rawRef"].alias("rawRef"))).alias("toolCalls"))
    repo = heads.select("path", repo_of(F.col("cwd")).alias("repo"))
    kept = msgs.where("role IN ('user', 'assistant')").join(listed, ["path", "line_no"], "left").join(repo, "path", "left")
    model = F.struct(variant_text(V, "$.message.provider").alias("providerID"), variant_text(V, "$.message.model").alias("modelID"))
    return kept.select(
        F.lit(1).alias("schemaVersion"), F.lit("pi").alias("source"), "id", F.concat(F.lit("pi:"), F.col("uuid")).alias("sessionId"), "ts", "role", _texts(F.col("content")).alias("text"), model.alias("model"),
        F.lit(None).cast("string").alias("agent"), "repo", tokens_of(V, "$.message.usage").alias("tokens"), F.coalesce(F.try_variant_get(V, "$.message.usage.cost.total", "double"), F.lit(0.0)).alias("cost"), "toolCalls",
    )


def sessions(lines: DataFrame) -> DataFrame:
    """One row for each file with a session header: title, bounds, usage."""
    v = parsed(lines)
    named = v.where((variant_text(V, "$.type") == "session_info") & (trimmed(variant_text(V, "$.name")) != "")).groupBy("path").agg(F.max_by(trimmed(variant_text(V, "$.name")), "line_no").alias("named"))
    said = messages(lines).where("role = 'user'").select("path", "line_no", trimmed(_texts(F.col("content"))).alias("text")).where("text <> ''").groupBy("path").agg(F.min_by("text", "line_no").alias("said"))
    last = v.groupBy("path").agg(F.max_by(iso_millis(variant_text(V, "$.timestamp")), "line_no").alias("last"))
    usage = events(lines).groupBy("sessionId").agg(F.sum("cost").alias("cost"), F.struct(*(F.sum(F.col("tokens")[c]).alias(c) for c in _COUNTS)).alias("tokens"))
    base = headers(lines).join(named, "path", "left").join(said, "path", "left").join(last, "path", "left").withColumn("id", F.concat(F.lit("pi:"), F.col("uuid")))
    title = F.coalesce("named", F.nullif(F.substring(F.substring_index("said", "\n", 1), 1, 60), F.lit("")))
    return base.join(usage, base["id"] == usage["sessionId"], "left").select(
        F.lit(1).alias("schemaVersion"), F.lit("pi").alias("source"), "id", title.alias("title"), F.col("cwd").alias("directory"), repo_of(F.col("cwd")).alias("repo"), F.col("ts_created").alias("tsCreated"), F.coalesce("last", "ts_created").alias("tsUpdated"),
        F.coalesce("cost", F.lit(0.0)).alias("cost"), "tokens", F.lit(None).cast("string").alias("parentSession"),
    )


def ignored_counts(lines: DataFrame) -> DataFrame:
    kind, role = variant_text(V, "$.type"), variant_text(V, "$.message.role")
    what = F.when(kind == "message", F.when(~role.isin("user", "assistant", "toolResult", "bashExecution"), F.concat(F.lit("role:"), role))).when(~kind.isin("session", "session_info"), F.concat(F.lit("type:"), kind))
    return parsed(lines).select(what.alias("kind")).where("kind IS NOT NULL").groupBy("kind").agg(F.count("*").alias("n"))


def raw_outputs(msgs: DataFrame) -> DataFrame:
    """(part_id, content, source, orphan) of results and runs with an output, those that belong to no call included."""
    found = results(msgs).select("path", "line_no", "id", "output").unionByName(bash_runs(msgs).select("path", "line_no", "id", "output")).where("output <> ''")
    lone = orphans(msgs).select("path", "line_no", F.lit(True).alias("orphan"))
    return found.join(lone, ["path", "line_no"], "left").select(F.col("id").alias("part_id"), F.col("output").alias("content"), F.lit("pi").alias("source"), F.coalesce("orphan", F.lit(False)).alias("orphan"))
