"""All registered queries of the archive jobs over the given tables, and their SQL."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from dialogmill.functions.columns import date_bound, fidelity, filters, format_ts, model_name, truncated
from dialogmill.operators import evaluate, maintain, normalise, profile, reading, search, textindex
from dialogmill.plans import bridge, records
from dialogmill.sources import archive, jsonl, relational
from dialogmill.sources.staging import shared_path, staged

#: The index of each folder of tables, written once in a session and read by all searches after that.
_indexes: dict[tuple[str, str], str] = {}


class Tables:
    """The bridge views of one folder."""

    def __init__(self, spark, sf_dir):
        self.spark, self.sf_dir = spark, sf_dir
        self.see = see = lambda sql: bridge.view(spark, sf_dir, sql)
        self.docs, self.events, self.sessions = see(bridge.DOCS), see(bridge.EVENTS), see(bridge.SESSIONS)
        self.raw, self.calls, self.queries = see(bridge.RAW), see(bridge.CALLS_SPARK), see(bridge.QUERIES)
        self.labels = see("SELECT * FROM labels")
        self.requests = self.sessions.select(F.concat(F.lit("r"), "id").alias("req_id"), F.col("id").alias("session_id"), format_ts(F.col("ts_created") + 120000).alias("at"))
        #: The archive before and after a pass: later messages are new, some texts are changed.
        self.old = self.docs.where("pmod(ts div 60000, 7) <> 3").withColumn("text", F.when(F.expr("pmod(ts div 60000, 7) = 4"), F.concat("text", F.lit(" (old)"))).otherwise(F.col("text")))
        self.new = self.docs.where("pmod(ts div 60000, 2) = 1")

    @property
    def index(self):
        """The index of this folder's documents; one that isn't that of the documents as they are now is written anew."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir)
        if key in _indexes:
            try:
                return textindex.current_index(self.docs, _indexes[key])
            except ValueError:
                pass
        _indexes[key] = shared_path(self.spark, "index")
        textindex.write_index(self.docs, _indexes[key])
        return textindex.read_index(self.spark, _indexes[key])

    @functools.cached_property
    def relational(self):
        return records.relational(self.see)

    @functools.cached_property
    def lines(self):
        return staged(records.lines(self.see), "lines")

    @functools.cached_property
    def messages(self):
        return staged(jsonl.messages(self.lines), "messages")

    @functools.cached_property
    def merged(self):
        """Events of both sources."""
        session, message, part = self.relational
        return staged(normalise.canonical_events(message, part, session).unionByName(jsonl.events(self.lines)), "merged")

    @functools.cached_property
    def merged_sessions(self):
        return staged(normalise.canonical_sessions(self.relational[0]).unionByName(jsonl.sessions(self.lines), allowMissingColumns=True), "merged-sessions")


def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


# --- search

RANKED_K, CTX = 10, 2


def _hits(t):
    return staged(search.ranked(t.queries, t.docs, RANKED_K, **t.index), "hits")


def bm25_search(t):
    return r6(search.with_sessions(_hits(t), t.sessions), "score").select("qid", "rank", "id", "score", "session_id", "session_title")


def filtered_search(t):
    where = filters(source="opencode", role="assistant", model="M_", after=1767225600000, before=1767225600000 + 400 * 86400000, agent="build")
    return r6(search.ranked(t.queries, t.docs, RANKED_K, where, **t.index), "score").select("qid", "rank", "id", "score")


def repo_search(t):
    where = filters(repo="repo4", session="S0", role="title", source="all")
    return r6(search.ranked(t.queries, t.docs, RANKED_K, where, **t.index), "score").select("qid", "rank", "id", "score")


def unknown_source_search(t):
    """An unknown source, and a prefix whose signs are no wildcards, have no rows."""
    return search.browse(t.docs, 50, where=filters(source="elsewhere") | filters(session="s%_")).select("id", "ts")


def command_hits(t):
    """Search over both sources, with commands: hits found by a command show it."""
    docs = staged(normalise.search_docs(t.merged, t.merged_sessions), "docs")
    asked = t.sessions.where("ts_created % 7 = 3").select(F.concat(F.lit("c"), "id").alias("qid"), F.concat(F.lit("run also-"), F.expr("cast(pmod(ts_created div 86400000, 9) AS string)")).alias("q"))
    hits = staged(search.ranked(asked, docs, 5), "hits")
    shown = search.snippets(search.excerpts(hits, 80), asked, column="cmd")
    return r6(shown, "score").select("qid", "rank", "id", "score", F.md5("excerpt").alias("md5"), "full_len", "full", "cmd_marked")


def no_terms(t):
    asked = t.queries.unionByName(t.sessions.select(F.col("id").alias("qid"), F.lit("the LA et --").alias("q")))
    return textindex.no_terms(asked)


def chrono_search(t):
    return search.by_time(t.queries, t.docs, RANKED_K, **t.index).select("qid", "rank", "id", "ts")


def chrono_search_oldest(t):
    return search.by_time(t.queries, t.docs, RANKED_K, newest=False, **t.index).select("qid", "rank", "id", "ts")


def chrono_browse_oldest(t):
    return search.browse(t.docs, 50, newest=False).select("id", "session_id", "ts", "role")


def chrono_browse(t):
    return search.browse(t.docs, 50).select("id", "session_id", "ts", "role")


def neighbor_messages(t):
    return search.neighbors(_hits(t), t.docs, CTX)


def hit_groups(t):
    return search.session_groups(_hits(t)).withColumn("hit_refs", F.array_join("hit_refs", ","))


def hit_neighbor_groups(t):
    hits = _hits(t)
    return search.session_groups(hits, search.neighbors(hits, t.docs, CTX)).select("qid", "session_id", F.array_join("neighbor_refs", ",").alias("neighbor_refs"))


def hit_excerpts(t):
    return search.excerpts(_hits(t), 200).select("qid", "id", "excerpt", "excerpt_len", "full_len", "full")


def hit_snippets(t):
    return search.snippets(_hits(t), t.queries).select("qid", "id", F.col("text_snippet").alias("snippet"), F.col("text_marked").alias("marked"))


def hit_totals(t):
    hits = _hits(t)
    return search.totals(hits, RANKED_K).join(search.missing_models(hits), "qid")


def index_postings(t):
    columns = (F.size("text") > 0).cast("bigint") + (F.size("cmd") > 0).cast("bigint")
    return t.index["index"].groupBy("term").agg(F.sum(columns).alias("docs"), F.sum("tf").alias("occurrences"))


def _upserted_index(t):
    """An index of the older documents, with a segment of changes, one of a document that is gone, and one with it again."""
    path = shared_path(t.spark, "index")
    textindex.write_index(t.old, path)
    textindex.add_segment(t.new, path)
    lost = t.old.where("role = 'title'")
    textindex.add_segment(t.old.limit(0), path, gone=lost)
    textindex.add_segment(lost.join(t.new.select("id"), "id", "left_anti").unionByName(t.new.where("role = 'title'")), path)
    return path


def index_after_upsert(t):
    """Searches over an index that upserts have brought up to date, before its segments are merged and after."""
    path, docs = _upserted_index(t), staged(maintain.upsert(t.old, t.new), "docs")
    parts = []
    for name in ("segments", "merged"):
        hits = staged(search.ranked(t.queries, docs, RANKED_K, **textindex.current_index(docs, path)), "hits")
        parts.append(r6(hits, "score").select(F.lit(name).alias("part"), "qid", "rank", "id", "score"))
        textindex.merge_segments(t.spark, path)
    return parts[0].unionByName(parts[1])


def index_lag(t):
    """The index of the older documents against the archive after a pass: it is behind; with a further segment it is equal."""
    path, docs = shared_path(t.spark, "index"), staged(maintain.upsert(t.old, t.new), "docs")
    textindex.write_index(t.old, path)
    before = staged(textindex.index_state(docs, textindex.read_index(t.spark, path)["stats"]), "lag")
    textindex.add_segment(t.new, path)
    after = textindex.index_state(docs, textindex.read_index(t.spark, path)["stats"])
    return before.withColumn("part", F.lit("before")).unionByName(after.withColumn("part", F.lit("after")))


def index_build(t):
    """The index written anew, and read back: each document's length and the number of its postings."""
    path = shared_path(t.spark, "index")
    textindex.write_index(t.docs, path)
    index = textindex.read_index(t.spark, path)
    return index["stats"].join(index["index"].groupBy("id").agg(F.count("*").alias("terms")), "id", "left").select("id", "dl", F.coalesce("terms", F.lit(0)).alias("terms"))


def raw_scan(t):
    needles = t.queries.select(F.col("qid").alias("nid"), F.element_at(F.split("q", " "), 2).alias("needle"))
    return search.raw_scan(needles, t.raw)


def raw_scan_refs(t):
    """Outputs of both sources that an event refers to, by the time of the event; those of one source only."""
    raw = normalise.raw_outputs(t.relational[2]).unionByName(jsonl.raw_outputs(t.messages), allowMissingColumns=True)
    needles = t.sessions.where("ts_created % 5 = 0").select(F.col("id").alias("nid"), F.concat(F.element_at(F.array(F.lit("OUT "), F.lit("shell "), F.lit("raw ")), F.expr("cast(pmod(ts_created div 86400000, 3) + 1 AS int)")), F.lit("1")).alias("needle"))
    refs, parts = staged(search.rawrefs(t.merged), "refs"), []
    for source in ("all", "pi", "elsewhere"):
        parts.append(search.raw_scan(needles, raw, refs, source, limit=3).withColumn("family", F.lit(source)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def rawrefs(t):
    return search.rawrefs(t.merged).select("raw_ref", "event_id", "session_id", "ts", "role", "tool", "cmd")


def raw_lookup(t):
    wanted = t.labels.where("toxic = 1").select(F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 6, "0")).alias("part_id")).distinct()
    return search.raw_lookup(wanted, t.raw).select("part_id", F.length("content").alias("n_chars"), F.md5("content").alias("md5"))


def eval_topk(t):
    """Questions are the whole first messages of sessions; the session must be among their hits."""
    asked = reading.message_index(t.events).where("idx = 0").select(F.col("session_id").alias("qid"), F.col("text").alias("q"), F.array("session_id").alias("expect"), F.lit(False).alias("known_miss"))
    return search.eval_topk(asked, t.docs, **t.index).agg(F.count("*").alias("questions"), *(F.count_if(f"top{k}").alias(f"top{k}") for k in (1, 3, 5)))


# --- reading


def message_index(t):
    return reading.message_index(t.docs).select("session_id", "idx", "id")


def read_as_of(t):
    return reading.read_as_of(reading.resolve_anchors(t.requests, t.docs), t.docs)


def read_counters(t):
    return reading.read_counters(reading.read_as_of(reading.resolve_anchors(t.requests, t.docs), t.docs))


def read_sessions(t):
    first = reading.message_index(t.events).where("idx = 1").select("session_id", F.col("id").alias("around"))
    asked = t.requests.withColumn("at", F.lit(None).cast("string")).join(first, "session_id", "left").select("req_id", "session_id", "around", F.lit(1).alias("ctx"), F.lit(3).alias("tail"), "at")
    return reading.read_sessions(asked, t.docs)[0]


def _read_requests(t):
    """Requests of all modes for each session."""
    numbered = reading.message_index(t.events)
    ends = numbered.groupBy("session_id").agg(F.max_by("id", "idx").alias("last"), F.min_by("id", F.abs(F.col("idx") - 1)).alias("second"), F.min("ts").alias("first_ts"))
    minute = format_ts(F.col("first_ts"))
    none = F.lit(None).cast("string")
    modes = [("whole", none, None, none), ("around", F.col("second"), None, none), ("unknown", F.lit("nobody"), None, none), ("tail", none, 2, none), ("tail-at", none, 1, minute), ("masked", F.col("last"), None, minute), ("bad", none, None, F.lit("2026-02-30"))]
    parts = [ends.select(F.concat(F.lit(f"{name}-"), "session_id").alias("req_id"), "session_id", around.alias("around"), F.lit(1).alias("ctx"), F.lit(tail).cast("int").alias("tail"), at.alias("at")) for name, around, tail, at in modes]
    return staged(functools.reduce(lambda a, b: a.unionByName(b), parts), "requests")


def read_modes(t):
    return reading.read_sessions(_read_requests(t), t.docs)[0]


def read_headers(t):
    return reading.read_sessions(_read_requests(t), t.docs)[1]


def anchors(t):
    """Anchors of all kinds: a message, one of another session, times, blanks and others."""
    first = t.events.groupBy("session_id").agg(F.min("id").alias("own"), F.min("ts").alias("ts"))
    kinds = [("own", F.col("own")), ("other", F.lit("m000000-0001")), ("digits", F.lit("1767225600123")), ("day", F.lit("2026-03-01")), ("minute", F.lit("2026-03-01T10:30")), ("second", F.lit("2026-03-01 10:30:15")), ("no_day", F.lit("2026-02-30")), ("blank", F.lit(" \t")), ("word", F.lit("soon"))]
    asked = first.select("session_id", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("at")) for k, v in kinds))).alias("x")).select(F.concat_ws("-", "x.kind", "session_id").alias("req_id"), "session_id", F.col("x.at").alias("at"))
    lost = first.select(F.concat(F.lit("lost-"), "session_id").alias("req_id"), F.concat(F.lit("no"), "session_id").alias("session_id"), F.col("own").alias("at"))
    return reading.resolve_anchors(asked.unionByName(lost), t.docs).select("req_id", "status", "anchor_ts")


def date_bounds(t):
    """First and last millisecond of years, months (13 rolls over), days and times."""
    day = F.expr("ts_created div 86400000")
    year, month, date = F.lit(2000) + F.pmod(day, F.lit(50)), F.pmod(day, F.lit(13)) + 1, F.pmod(day, F.lit(28)) + 1
    forms = [F.format_string("%04d", year), F.format_string("%04d-%02d", year, month), F.format_string("%04d-%02d-%02d", year, F.least(month, F.lit(12)), date), F.format_string("%04d-%02d-%02dT10:00:00Z", year, F.least(month, F.lit(12)), date)]
    asked = t.sessions.select("id", F.posexplode(F.array(*forms)).alias("form", "text"))
    return asked.select("id", "form", "text", date_bound(F.col("text"), False).alias("low"), date_bound(F.col("text"), True).alias("high"))


def fidelity_flags(t):
    return t.docs.select("id", F.array_join(fidelity(F.col("source")), "; ").alias("limits"))


def session_tail(t):
    return reading.tail(t.docs, 3).select("session_id", "id", "back")


def keyset_page(t):
    return reading.keyset_page(t.docs, 1767225600000 + 3 * 86400000, "m000003-0002", 20).select("id", "ts", "has_more")


def shown_windows(t):
    spans = _hits(t).where("role <> 'title'").join(reading.message_index(t.docs).select("id", "idx"), "id").select(F.col("qid").alias("req_id"), "session_id", F.greatest(F.col("idx") - 1, F.lit(0)).alias("low"), (F.col("idx") + 1).alias("high"))
    return reading.merge_windows(spans).select("req_id", "session_id", "low", "high")


def gap_markers(t):
    shown = reading.message_index(t.docs).where("pmod(ts div 60000, 3) <> 1").select(F.lit("r").alias("req_id"), "session_id", "idx", "id")
    totals = reading.message_index(t.docs).groupBy("session_id").agg(F.count("*").alias("total")).withColumn("req_id", F.lit("r"))
    return reading.gap_markers(shown, totals).select("id", "idx", "gap_before", "gap_after")


def text_chunks(t):
    return reading.chunks(t.events, "text", 400, "id")


def messages_export(t):
    return reading.messages_export(t.docs)


def _bundles(t):
    """The calls of a session's hour as one message."""
    hour = F.concat("session_id", F.lit("-"), F.expr("cast(ts div 3600000 AS string)"))
    calls = F.transform(F.array_sort(F.collect_list(F.struct("id", "tool", "cmd"))), lambda c: F.struct(c["tool"].alias("tool"), c["cmd"].alias("cmd"), c["id"].alias("rawRef")))
    return t.calls.groupBy(hour.alias("id")).agg(calls.alias("toolCalls"))


def events_export(t):
    """Messages of both sources with their calls."""
    rows = reading.events_export(t.merged)
    calls = _event_rows(t.merged).select("id", "calls")
    return rows.join(calls, "id").select("session_id", "index", "id", "date", "role", F.md5(F.coalesce("text", F.lit(""))).alias("md5"), F.size("toolCalls").alias("n_calls"), "calls")


def call_chunks(t):
    return reading.call_chunks(_bundles(t), 3)


def calls_summary(t):
    return reading.calls_summary(_bundles(t))


def shown_texts(t):
    cut = truncated(F.col("text"))
    return t.docs.select("id", F.md5(cut["shown"]).alias("md5"), cut["shown_len"].alias("shown_len"), cut["total"].alias("total"), cut["cut"].alias("cut"))


# --- normalisation of source records


def _event_rows(events):
    said = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    calls = F.array_join(F.transform("toolCalls", lambda c: F.concat_ws("|", said(c["tool"]), said(c["cmd"]), said(c["exitCode"]), said(c["rawRef"]))), ";")
    return events.select(
        "id", F.col("sessionId").alias("session_id"), "ts", "role", F.md5(F.coalesce("text", F.lit(""))).alias("md5"), model_name(F.col("model")).alias("model"), "agent", "repo",
        *(F.col("tokens")[k].alias(f"tokens_{k.lower()}") for k in ("in", "out", "cacheRead", "cacheWrite")), "cost", F.coalesce(calls, F.lit("")).alias("calls"),
    )


def _session_rows(sessions):
    n = lambda c: F.coalesce(F.col("tokens")[c], F.lit(0)).alias(f"tokens_{c}")
    return sessions.select("id", "title", "repo", F.col("tsCreated").alias("ts_created"), F.col("tsUpdated").alias("ts_updated"), "cost", n("in"), n("out"), "parentSession")


def relational_events(t):
    session, message, part = t.relational
    return _event_rows(normalise.canonical_events(message, part, session))


def relational_sessions(t):
    return _session_rows(normalise.canonical_sessions(t.relational[0]))


def relational_outputs(t):
    return normalise.raw_outputs(t.relational[2]).select("part_id", "content")


def source_delta(t):
    """Extracts of the three tables, read back from a watermark on: messages after it, and the parts of these."""
    path = shared_path(t.spark, "extract")
    for name, rows in zip(("session", "message", "part"), t.relational):
        rows.write.parquet(f"{path}/{name}.parquet")
    mark = 1767225600000 + 30 * 86400000
    messages = relational.read_messages(t.spark, path, mark)
    parts = relational.read_parts(t.spark, path, messages).groupBy(F.col("message_id").alias("id")).agg(F.count("*").alias("n"))
    sessions = relational.read_sessions(t.spark, path, mark, inclusive=True).select("id", F.lit(0).cast("bigint").alias("n"))
    return messages.select("id").join(parts, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n")).unionByName(sessions)


def line_events(t):
    return _event_rows(jsonl.events(t.lines))


def line_sessions(t):
    return _session_rows(jsonl.sessions(t.lines))


def line_orphans(t):
    return jsonl.orphans(t.messages).select("path", "line_no", "id", "kind", "output")


def line_unproved(t):
    return jsonl.calls_without_proof(t.messages)


def line_ignored(t):
    return jsonl.ignored_counts(t.lines)


def line_outputs(t):
    return jsonl.raw_outputs(t.messages).select("part_id", "content", "orphan")


def line_problems(t):
    """Files with a fault each: a cut line, another header, unsafe ids, ids used twice, messages without a time."""
    fault = F.expr("cast(substring(path, 2) AS bigint) % 10")
    said = (F.col("line_no") > 1) & (F.col("line_no") < 1000000)
    line = (
        F.when((fault == 3) & (F.col("line_no") == 1), F.expr("substring(line, 1, length(line) - 1)")).when((fault == 4) & (F.col("line_no") == 1), F.replace(F.col("line"), F.lit('"session"'), F.lit('"note"')))
        .when((fault == 5) & said, F.replace(F.col("line"), F.lit('"id":"t'), F.lit('"id":"../t'))).when((fault == 7) & said, F.replace(F.col("line"), F.lit('"timestamp"'), F.lit('"when"'))).otherwise(F.col("line"))
    )
    twice = t.lines.where((fault == 6) & said & (F.col("line_no") % 10 == 2)).withColumn("line_no", F.col("line_no") + 7)
    return jsonl.problems(t.lines.withColumn("line", line).unionByName(twice))


def _files(t):
    """A listing, and the state of an earlier pass: new, grown, unread, unchanged and vanished files."""
    n = F.expr("ts_created div 86400000")
    listing = t.sessions.select(F.col("id").alias("path"), F.length("id").cast("bigint").alias("size"), F.col("ts_created").alias("mtime"), F.pmod(n, F.lit(4)).alias("kind"))
    uuid = F.when(F.col("kind") != 2, F.concat(F.lit("u-"), "path"))
    state = listing.where("kind <> 0").select("path", (F.col("size") - F.when(F.col("kind") == 1, 1).otherwise(0)).alias("size"), "mtime", uuid.alias("uuid"))
    gone = listing.select(F.concat(F.lit("gone-"), "path").alias("path"), "size", "mtime", F.lit("u").alias("uuid"))
    return listing.drop("kind"), state.unionByName(gone)


def changed_files(t):
    return jsonl.changed_files(*_files(t)).select("path")


def file_state(t):
    listing, state = _files(t)
    read = jsonl.changed_files(listing, state).select("path", F.concat(F.lit("new-"), "path").alias("uuid"))
    return jsonl.advance_files(listing, state, read).select("path", "size", "uuid")


def shared_uuids(t):
    """Session ids that two files have: here those of every fifth file and its copy."""
    files = t.sessions.select(F.col("id").alias("path"), F.concat(F.lit("u-"), "id").alias("uuid"))
    copies = files.where("cast(substring(path, 2) AS bigint) % 5 = 0").withColumn("path", F.concat("path", F.lit("-copy")))
    return jsonl.shared_uuids(files.unionByName(copies))


# --- both sources in one archive


def search_docs(t):
    return normalise.search_docs(t.merged, t.merged_sessions).select("id", "session_id", "ts", "role", "agent", "repo", "model", "cmd", F.md5("text").alias("md5"), "source")


def archive_passes(t):
    """The archive after three passes: earlier messages with older texts, all of them, and the second source."""
    path = shared_path(t.spark, "archive")
    first = t.merged.where("source = 'opencode' AND pmod(ts div 60000, 5) < 3").withColumn("text", F.concat("text", F.lit(" (old)")))
    for turn, rows in enumerate((first, t.merged.where("source = 'opencode'"), t.merged.where("source = 'pi'"))):
        archive.write_events(t.spark, rows, path, exists=turn > 0)
    return _event_rows(archive.read_archive(t.spark, path))


def rebuild_equals_passes(t):
    """Fingerprints of an archive of two passes and of one written at once, with its rows."""
    paths = [shared_path(t.spark, "archive") for _ in range(2)]
    archive.write_events(t.spark, t.merged.where("pmod(ts div 60000, 2) = 0"), paths[0], exists=False)
    archive.write_events(t.spark, t.merged, paths[0])
    archive.write_events(t.spark, t.merged, paths[1], exists=False)
    marks = [maintain.fingerprint(archive.read_archive(t.spark, p)).first()["fingerprint"] for p in paths]
    return archive.read_archive(t.spark, paths[0]).agg(F.count("*").alias("rows")).withColumn("equal", F.lit(marks[0] == marks[1]))


def session_passes(t):
    path = shared_path(t.spark, "sessions")
    older = t.merged_sessions.where("pmod(tsCreated div 86400000, 3) = 0").withColumn("title", F.lit("older"))
    archive.write_sessions(t.spark, older, path, exists=False)
    archive.write_sessions(t.spark, t.merged_sessions, path)
    return _session_rows(archive.read_archive(t.spark, path))


def raw_passes(t):
    """Raw outputs after two passes; the second has some changed contents and some new ones."""
    path, n = shared_path(t.spark, "raw"), F.expr("cast(substring(part_id, 2) AS bigint)")
    archive.write_raw(t.spark, t.raw.where(n % 3 != 0), path, exists=False)
    archive.write_raw(t.spark, t.raw.withColumn("content", F.when(n % 3 == 1, F.concat("content", F.lit("+"))).otherwise(F.col("content"))), path)
    return archive.read_archive(t.spark, path).select("part_id", F.md5("content").alias("md5"), "source")


def migrated(t):
    """Counts of a migration from the single-file layout, with a broken line and sessions without events."""
    path = shared_path(t.spark, "legacy")
    rows = t.merged.where("source = 'pi'").select(F.to_json(F.struct("*")).alias("value"))
    rows.unionByName(t.sessions.where("ts_created % 11 = 0").select(F.lit("{broken").alias("value"))).write.text(f"{path}/events")
    t.merged_sessions.select(F.to_json(F.struct("*")).alias("value")).write.text(f"{path}/sessions")
    for _ in range(2):
        found = archive.migrate(t.spark, f"{path}/events", f"{path}/sessions", f"{path}/new")
    return found


def title_upkeep(t):
    """Search rows after an upsert of sessions: some titles are new, some are empty now."""
    n = F.expr("cast(substring(id, 2) AS bigint) % 3")
    touched = t.sessions.where(n < 2).select("id", F.when(n == 0, F.concat(F.lit("New "), "id")).otherwise("").alias("title"), "repo", "source", F.col("ts_created").alias("tsCreated"), F.lit(0).cast("bigint").alias("tsUpdated"))
    return maintain.refresh_titles(t.docs, touched).where("role = 'title'").select("id", "session_id", "ts", "text", "source")


def rawref_upkeep(t):
    """References after an upsert of events: those of every second turn of the first source have a new one."""
    touched = t.merged.where("source = 'opencode' AND pmod(ts div 60000, 4) = 1").withColumn("toolCalls", F.array(F.struct(F.lit("t").alias("tool"), F.lit("c").alias("cmd"), F.lit(0).alias("exitCode"), F.concat(F.lit("new-"), "id").alias("rawRef"))))
    return maintain.refresh_rawrefs(search.rawrefs(t.merged), touched).select("raw_ref", "event_id", "cmd")


# --- upkeep


def upsert_events(t):
    return maintain.upsert(t.old, t.new.unionByName(t.new)).select("id", "ts", F.md5("text").alias("md5"))


def upsert_status(t):
    return maintain.ingest_summary(("events", maintain.upsert_status(t.old, t.new))).select("status", "n")


def pass_summary(t):
    """What a pass did: events by status, orphans and ignored lines."""
    orphans = jsonl.orphans(t.messages).select(F.col("kind").alias("status"))
    ignored = jsonl.ignored_counts(t.lines).select(F.explode(F.expr("sequence(1, n)")).alias("x"), F.col("kind").alias("status"))
    return maintain.ingest_summary(("events", maintain.upsert_status(t.old, t.new)), ("orphans", orphans), ("ignored", ignored))


def written_summary(t):
    """What the writes of a pass have seen: events, sessions and raw outputs; with orphans and lines passed over."""
    path, n = shared_path(t.spark, "archive"), F.expr("cast(substring(part_id, 2) AS bigint)")
    first = t.merged.where("source = 'opencode' AND pmod(ts div 60000, 5) < 3").withColumn("text", F.concat("text", F.lit(" (old)")))
    archive.write_events(t.spark, first, f"{path}/events", exists=False)
    archive.write_sessions(t.spark, t.merged_sessions.where("pmod(tsCreated div 86400000, 3) = 0").withColumn("title", F.lit("older")), f"{path}/sessions", exists=False)
    archive.write_raw(t.spark, t.raw.where(n % 3 != 0), f"{path}/raw", exists=False)
    seen = {
        "events": archive.write_events(t.spark, t.merged, f"{path}/events"), "sessions": archive.write_sessions(t.spark, t.merged_sessions, f"{path}/sessions"),
        "raw": archive.write_raw(t.spark, t.raw.withColumn("content", F.when(n % 3 == 1, F.concat("content", F.lit("+"))).otherwise(F.col("content"))), f"{path}/raw"),
    }
    rows = t.spark.createDataFrame([(kind, status, count) for kind, found in seen.items() for status, count in found.items()], "kind string, status string, n bigint")
    orphans = jsonl.orphans(t.messages).groupBy(F.col("kind").alias("status")).agg(F.count("*").alias("n")).select(F.lit("orphans").alias("kind"), "status", "n")
    return rows.unionByName(orphans).unionByName(jsonl.ignored_counts(t.lines).select(F.lit("ignored").alias("kind"), F.col("kind").alias("status"), "n")).where("n > 0")


def fingerprint_passes(t):
    """The fingerprint after a pass, from the sums before it and what the pass has changed."""
    parts = staged(maintain.fingerprint_parts(t.old), "parts")
    come = maintain.latest(t.new)
    after = staged(maintain.advance_parts(parts, t.old.join(t.new.select("id"), "id", "left_semi").select(*t.old.columns), come), "parts")
    again = maintain.advance_parts(after, come, come)
    return maintain.fingerprint_of(again)


def latest_version(t):
    versions = t.old.withColumn("pass", F.lit(1)).unionByName(t.new.withColumn("pass", F.lit(2)))
    return maintain.latest(versions, order="pass").select("id", "pass", F.md5("text").alias("md5"))


def table_lag(t):
    return maintain.table_lag(t.docs, t.old)


def advance_state(t):
    """Watermarks after a pass over one source; that of the other starts again."""
    state = t.old.groupBy("source").agg((F.max("ts") + 10**12).alias("watermark"))
    return maintain.advance_state(state, t.docs, reset=("pi",))


def archive_fingerprint(t):
    return maintain.fingerprint(t.docs)


# --- statistics and evaluation


def source_status(t):
    return profile.source_status(t.docs, t.sessions)


def merged_status(t):
    """Both sources, with the raw outputs that their events refer to."""
    docs = normalise.search_docs(t.merged, t.merged_sessions)
    return profile.source_status(docs, t.merged_sessions, refs=search.rawrefs(t.merged))


def part_profile(t):
    return profile.part_profile(t.relational[2])


def role_counts(t):
    return profile.role_counts(t.relational[1])


def busy_messages(t):
    """Messages with several calls: here every third tool part counts for the message before it."""
    n = F.expr("cast(substring(message_id, 2, 6) AS bigint)")
    part = t.relational[2].withColumn("message_id", F.when(n % 3 == 0, F.concat(F.lit("busy-"), (n % 50).cast("string"))).otherwise(F.col("message_id")))
    return profile.busy_messages(part)


def model_cost_summary(t):
    events = t.calls.select(F.col("tool").alias("model"), "cost", F.length("cmd").alias("tokens_in"), F.length("id").alias("tokens_out"))
    return r6(profile.model_cost_summary(events), "cost")


def merged_model_costs(t):
    """Costs and tokens of both sources by model."""
    return r6(profile.model_cost_summary(t.merged.select(F.col("model.modelID").alias("model"), "cost", F.col("tokens")["in"].alias("tokens_in"), F.col("tokens")["out"].alias("tokens_out"))), "cost")


def source_profile(t):
    return profile.source_profile(t.calls)


def turns(t):
    return evaluate.turns(t.docs).select("session_id", "turn", "id", F.size("answers").alias("answers"), F.length(F.array_join("answers", "\n\n")).alias("answer_chars"))


def turn_candidates(t):
    return evaluate.turn_candidates(t.docs, t.sessions, asking=ASKS).select("session_id", "id", "q_len", "a_len", "score")


ASKS = r"\?|(?i)(what|how|why|que|the|der|le)"


def _sample(t):
    return staged(evaluate.turn_sample(evaluate.turn_candidates(t.docs, t.sessions, asking=ASKS), 7, least=2, cap=5), "sample")


def turn_sample(t):
    return _sample(t).select("qid", "id", "repo")


def blind_export(t):
    return evaluate.blind_export(_sample(t), 3).select("place", "qid", F.md5("question").alias("md5"))


def default_turn_candidates(t):
    """With the patterns that the sampler has by default; every second question begins with one of its words."""
    asked = F.when(F.expr("role = 'user' AND pmod(ts div 86400000, 2) = 0"), F.concat(F.lit(" Pourquoi\t"), "text")).otherwise(F.col("text"))
    return evaluate.turn_candidates(t.docs.withColumn("text", asked), t.sessions).select("session_id", "id", "q_len", "a_len", "score")


def question_rollup(t):
    return evaluate.question_rollup(evaluate.turn_candidates(t.docs, t.sessions, asking=ASKS), "repo", "score")


def _curated(sample):
    """Curated rows with a fault each, by the number of their question."""
    n = F.expr("cast(substring(qid, 2) AS int) % 11")
    facts = F.when(n == 3, F.array(F.lit("one"))).when(n == 4, F.array(F.lit("one"), F.lit(" \t"))).otherwise(F.array(F.lit("one"), F.lit("two")))
    start = F.substring("question", 1, 60)
    q = F.when(n == 1, F.concat(start, F.lit(" in short?"))).when(n == 2, F.concat(F.lit("Another way to ask, "), start)).when(n == 8, F.lit("Why?"))
    return sample.select(
        F.when(n == 9, F.concat(F.lit("x"), "qid")).otherwise(F.col("qid")).alias("qid"), q.alias("q"), facts.alias("expect"), F.when(n == 5, "other").otherwise("fait").alias("type"),
        F.when(n == 6, F.lit(None)).otherwise("high").alias("specificity"), F.when(n != 7, F.lit(True)).alias("self_contained"),
    )


def question_problems(t):
    sample, docs = _sample(t), t.docs.withColumn("text", F.concat(F.lit("<system-reminder>x\ny</system-reminder> "), F.regexp_replace("text", " ", "  ")))
    moved = sample.withColumn("session_id", F.when(F.expr("cast(substring(qid, 2) AS int) % 11 = 10"), F.lit("nowhere")).otherwise(F.col("session_id")))
    found = evaluate.validate_questions(_curated(sample), moved, docs, t.sessions)
    return found.select("qid", F.array_join("problems", "; ").alias("problems"))


def question_items(t):
    """Curated rows are given out if none has a problem: the good ones are, all of them together are not."""
    sample = _sample(t)
    curated = _curated(sample)
    good = staged(curated.where("try_cast(substring(qid, 2) AS int) % 11 = 0"), "curated")
    items = lambda rows, name: evaluate.question_items(rows, evaluate.validate_questions(rows, sample, t.docs, t.sessions)).select(F.lit(name).alias("part"), "qid")
    return items(good, "good").unionByName(items(curated, "all"))


TOOL = evaluate.Tool("archivist", ("ingest", "refresh"), ("--corpus", "--limit"))


def _audited(t, patterns=records.AUDIT_PATTERNS):
    responses = staged(records.responses(t.see), "responses")
    return responses, *evaluate.audit_calls(staged(evaluate.call_commands(responses), "commands"), patterns, TOOL)


def call_commands(t):
    return evaluate.call_commands(records.responses(t.see)).select("id", "call_index", "command", "origin")


def audit_deviations(t):
    return _audited(t)[1].select("id", "call_index", "pattern", "invalidating")


def audit_review(t):
    return _audited(t)[2]


def audit_summary(t):
    return evaluate.audit_summary(_audited(t, records.WHOLE_AUDIT)[1], records.WHOLE_AUDIT).select("pattern", "calls", "questions", "invalidating", "patterns")


def audit_status(t):
    responses, deviations, _, unanalysable = _audited(t)
    return evaluate.audit_status(responses, deviations, unanalysable)


def pattern_audit(t):
    """The audit with another list of patterns, over raw outputs."""
    texts = t.raw.select(F.col("part_id").alias("id"), F.lit(0).alias("call_index"), F.col("content").alias("command"))
    return evaluate.audit_summary(evaluate.audit_calls(texts, AUDIT)[0], AUDIT).select("pattern", F.col("calls").alias("n"), "questions", "invalidating")


AUDIT = [("mit", r"MIT License", False), ("apache", r"Apache License", False), ("gpl", r"GNU General Public", True)]

_ALL = [
    bm25_search, filtered_search, repo_search, unknown_source_search, command_hits, no_terms, chrono_search, chrono_browse, chrono_search_oldest, chrono_browse_oldest, neighbor_messages, hit_groups, hit_neighbor_groups, hit_excerpts, hit_snippets, hit_totals,
    index_postings, index_build, index_after_upsert, index_lag, raw_scan, raw_scan_refs, rawrefs, raw_lookup, eval_topk,
    message_index, read_as_of, read_counters, read_sessions, read_modes, read_headers, anchors, date_bounds, fidelity_flags, session_tail, keyset_page, shown_windows, gap_markers, text_chunks, messages_export, events_export,
    call_chunks, calls_summary, shown_texts, relational_events, relational_sessions, relational_outputs, source_delta, line_events, line_sessions, line_orphans, line_unproved, line_ignored, line_outputs, line_problems,
    changed_files, file_state, shared_uuids, search_docs, archive_passes, rebuild_equals_passes, session_passes, raw_passes, migrated, title_upkeep, rawref_upkeep,
    upsert_events, upsert_status, pass_summary, written_summary, fingerprint_passes, latest_version, table_lag, advance_state, archive_fingerprint,
    source_status, merged_status, part_profile, role_counts, busy_messages, model_cost_summary, merged_model_costs, source_profile, turns, turn_candidates, default_turn_candidates, turn_sample, blind_export, question_rollup,
    question_problems, question_items, call_commands, audit_deviations, audit_review, audit_summary, audit_status, pattern_audit,
]


def _query(f):
    return lambda spark, sf_dir: f(Tables(spark, sf_dir))


def queries():
    return {f.__name__: _query(f) for f in _ALL}


def oracle_sql():
    from dialogmill.oracle import SQL

    return dict(SQL)
