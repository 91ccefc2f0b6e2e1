import decimal
import json
import random

import pytest

from dialogmill import catalog
from dialogmill.functions import columns
from dialogmill.operators import evaluate, maintain, normalise, reading, search, textindex
from dialogmill.sources import archive, jsonl
from dialogmill.streaming.upsert import stream_upsert

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "events documents benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return round(float(v), 6) if isinstance(v, (int, float, decimal.Decimal)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_against_sql(spark, duck, name):
    got, want = catalog.queries()[name](spark, SF), duck.sql(catalog.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = want.select(*(f'"{c}"' for c in columns)).fetchall()
    assert sorted(str(plain(tuple(r))) for r in got.select(*columns).collect()) == sorted(str(plain(r)) for r in rows)


@pytest.mark.parametrize("name", ["date_bounds", "anchors", "messages_export", "read_as_of", "line_events", "line_sessions", "source_profile"])
def test_query_in_another_zone(spark, duck, name):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        test_query_against_sql(spark, duck, name)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("name", ["line_unproved", "line_orphans", "line_events"])
def test_query_with_joins_by_shuffles(spark, duck, name):
    """Large tables aren't broadcast; what is dealt by file then has its partitions merged in each part of a union by itself."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    held = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        test_query_against_sql(spark, duck, name)
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["line_outputs", "rawrefs", "merged_status", "rawref_upkeep", "pass_summary"])
def test_more_queries_with_joins_by_shuffles(spark, duck, name):
    """These go through the step that brings calls and runs of a file together, too."""
    test_query_with_joins_by_shuffles(spark, duck, name)


def test_times_are_in_utc(spark):
    asked = ["1970", "1970-01-01T00:00", "2026-03-08T02:30:00", "2026-03-08 02:30", "1970-01-01T00:00:00+02:00", "2026-03-08T02:30:00.250Z", "2026-02-30", "2026-02-30T10:00:00Z", "soon", None]
    df = spark.createDataFrame([(a,) for a in asked], "a string")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = df.select("a", columns.date_bound(df.a, False).alias("low"), columns.anchor_millis(df.a).alias("at"), columns.iso_millis(df.a).alias("iso"), columns.format_ts(columns.iso_millis(df.a)).alias("text")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    gap = 1772937000000
    assert [(r.low, r.at, r.iso) for r in rows] == [
        (0, None, None), (0, 0, 0), (gap, gap, gap), (gap, gap, gap), (-7200000, None, -7200000), (gap + 250, None, gap + 250), (1772409600000, None, None), (None, None, None), (None, None, None), (None, None, None),
    ]
    assert [r.text for r in rows] == ["?", "1970-01-01 00:00", "2026-03-08 02:30", "2026-03-08 02:30", "1969-12-31 22:00", "2026-03-08 02:30", "?", "?", "?", "?"]


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def docs_of(spark, rows):
    data = [(i, s, ts, role, None, None, None, cmd, text, "opencode") for i, s, ts, role, text, cmd in rows]
    return spark.createDataFrame(data, "id string, session_id string, ts bigint, role string, agent string, repo string, model string, cmd string, text string, source string")


def test_search_finds_phrases_commands_and_titles(spark):
    docs = docs_of(spark, [("a", "s1", 1, "user", "le proxy 461 répond chutes.ai", ""), ("b", "s1", 2, "assistant", "", "git revert HEAD"), ("c", "s2", 3, "user", "chutes de neige, ai", ""), ("s2", "s2", 3, "title", "proxy cache", "")])
    queries = spark.createDataFrame([("q1", "chutes.ai"), ("q2", "git revert"), ("q3", "le la les"), ("q4", "repond")], "qid string, q string")
    found = {(r.qid, r.id) for r in textindex.bm25(queries, docs).collect()}
    assert found == {("q1", "a"), ("q2", "b"), ("q4", "a")}
    assert [r.qid for r in textindex.no_terms(queries).collect()] == ["q3"]


def test_neighbors_of_a_title_and_snippets(spark):
    docs = docs_of(spark, [("m1", "s", 1, "user", "one", ""), ("m2", "s", 2, "user", "two", ""), ("s", "s", 2, "title", "t", ""), ("z", "s", 3, "user", "three", "")])
    hits = docs.where("role = 'title'").selectExpr("'q' qid", "1 rank", "id", "session_id", "ts", "role")
    assert sorted(r.id for r in search.neighbors(hits, docs, 1).collect()) == ["m2", "z"]


def test_windows_merge_and_chunks_rejoin(spark):
    spans = spark.createDataFrame([("r", "s", 0, 2), ("r", "s", 3, 4), ("r", "s", 6, 8)], "req_id string, session_id string, low int, high int")
    assert sorted((r.low, r.high) for r in reading.merge_windows(spans).collect()) == [(0, 4), (6, 8)]
    text = "abc😀def" * 7
    parts = reading.chunks(spark.createDataFrame([("a", text), ("b", None)], "id string, text string"), "text", 5, "id").collect()
    assert "".join(r.part for r in sorted(parts, key=lambda r: r.offset) if r.id == "a") == text
    assert [(r.offset, r.end, r.complete) for r in parts if r.id == "b"] == [(0, 0, True)]


def test_anchors(spark):
    docs = docs_of(spark, [("m1", "s", 5, "user", "one", ""), ("m2", "t", 6, "user", "two", "")])
    asked = spark.createDataFrame([("1", "s", "m1"), ("2", "s", "m2"), ("3", "s", "2026-02-30"), ("4", "s", "2026-02-28"), ("5", "s", " "), ("6", "x", "m1")], "req_id string, session_id string, at string")
    got = {r.req_id: (r.status, r.anchor_ts) for r in reading.resolve_anchors(asked, docs).collect()}
    assert got == {"1": ("ok", 5), "2": ("other_session", None), "3": ("invalid", None), "4": ("ok", 1772323199999), "5": ("empty", None), "6": ("not_found", None)}


def test_relational_source(spark):
    session = spark.createDataFrame([("s1", None, "/root/shop", "Bug", 1, 9, 0.5, 1, 2, 3, 4, 5), ("s2", "s1", "/root", "Sub", 2, 3, None, None, None, None, None, None)], "id string, parent_id string, directory string, title string, time_created bigint, time_updated bigint, cost double, tokens_input bigint, tokens_output bigint, tokens_reasoning bigint, tokens_cache_read bigint, tokens_cache_write bigint")
    message = spark.createDataFrame([("m1", "s1", 1, 1, json.dumps({"role": "assistant", "agent": "build", "model": {"providerID": "p", "modelID": "m"}})), ("m2", "s1", 2, 2, json.dumps({"role": "system"}))], "id string, session_id string, time_created bigint, time_updated bigint, data string")
    tool = {"type": "tool", "tool": "bash", "state": {"input": {"command": "git revert"}, "output": "done", "metadata": {"exitCode": "1"}}}
    part = spark.createDataFrame([("p2", "m1", json.dumps(tool)), ("p1", "m1", json.dumps({"type": "text", "text": "first"})), ("p3", "m1", json.dumps({"type": "step-finish", "cost": 0.25, "tokens": {"input": 7, "cache": {"read": 2}}})), ("p4", "m1", "{broken"), ("p5", "m1", json.dumps({"type": "text", "text": "last"}))], "id string, message_id string, data string")
    sessions = {r.id: r for r in normalise.canonical_sessions(session).collect()}
    assert (sessions["s1"].repo, sessions["s2"].repo, sessions["s2"].tokens.out) == ("shop", "root", 0)
    (event,) = normalise.canonical_events(message, part, session).collect()
    assert (event.text, event.cost, event.tokens["in"], event.tokens.cacheRead, event.repo) == ("first\n\nlast", 0.25, 7, 2, "shop")
    assert [tuple(c) for c in event.toolCalls] == [("bash", "git revert", 1, "p2")]
    assert [tuple(r)[:2] for r in normalise.raw_outputs(part).collect()] == [("p2", "done")]
    docs = normalise.search_docs(normalise.canonical_events(message, part, session), normalise.canonical_sessions(session))
    assert sorted((r.id, r.role, r.model, r.cmd, r.text) for r in docs.collect()) == [("m1", "assistant", "p/m", "git revert", "first\n\nlast"), ("s1", "title", None, "", "Bug"), ("s2", "title", None, "", "Sub")]
    assert (normalise.canonical_sessions(session, home="/root").where("id = 's2'").first().repo, sessions["s2"].repo) == (None, "root")


def line(kind, i=None, **more):
    return json.dumps({"type": kind, "id": i, "timestamp": "2026-06-10T10:00:00Z"} | more)


def said(i, role, content=(), ts=1, **more):
    return line("message", i, message={"role": role, "content": list(content), "timestamp": ts} | more)


def test_jsonl_source(spark, tmp_path):
    call = lambda i, c: {"type": "toolCall", "id": i, "name": "bash", "arguments": {"command": c}}
    text = lambda t: {"type": "text", "text": t}
    lines = [
        line("session", "u1", version=3, cwd="/root/x"), said("a", "user", [text("fix it\nplease")], 5), said("b", "assistant", [text("ok"), call("c1", "ls"), call("c2", "pwd")], 6),
        said("r", "toolResult", [text("files")], toolCallId="c1"), line("message", "x1", message={"role": "bashExecution", "command": "pwd", "output": "/root", "exitCode": 0}),
        line("message", "x2", message={"role": "bashExecution", "command": "id", "output": "me"}), said("r2", "toolResult", [text("again")], toolCallId="c1"), line("compaction", "k"),
    ]
    (tmp_path / "subagent-artifacts").mkdir()
    (tmp_path / "one.jsonl").write_text("\n".join(lines) + "\n" + '{"half')
    (tmp_path / "subagent-artifacts" / "no.jsonl").write_text("{}\n")
    listing = jsonl.discover(spark, str(tmp_path))
    assert listing.count() == 1
    assert jsonl.changed_files(listing, listing.selectExpr("path", "size", "mtime", "'u1' uuid")).count() == 0
    read = jsonl.read_lines(spark, str(tmp_path)).cache()
    assert read.count() == 8 and jsonl.problems(read).count() == 0
    events = {r.id: r for r in jsonl.events(read).collect()}
    assert sorted(events) == ["pi:u1:a", "pi:u1:b"]
    assert [tuple(c) for c in events["pi:u1:b"].toolCalls] == [("bash", "ls", None, "pi:u1:r"), ("bash", "pwd", 0, "pi:u1:x1")]
    assert sorted((r.id, r.kind) for r in jsonl.orphans(jsonl.messages(read)).collect()) == [("pi:u1:r2", "result"), ("pi:u1:x2", "bash")]
    (session,) = jsonl.sessions(read).collect()
    assert (session.title, session.repo) == ("fix it", "x")
    assert [tuple(r) for r in jsonl.ignored_counts(read).collect()] == [("type:compaction", 1)]
    bad = spark.createDataFrame([("f", 1, line("session", "../u")), ("f", 2, ""), ("f", 3, said("a", "user")), ("f", 4, said("a", "user"))], "path string, line_no int, line string")
    assert {r.problem for r in jsonl.problems(bad).collect()} == {"no JSON", "no session header", "id used twice"}


def test_archive_upsert_stream_and_fingerprint(spark, tmp_path):
    schema = archive.EVENTS
    event = lambda i, s, ts, text: {"id": i, "sessionId": s, "ts": ts, "role": "user", "text": text, "source": "pi"}
    feed, store = tmp_path / "feed", str(tmp_path / "store")
    feed.mkdir()
    (feed / "1.json").write_text("\n".join(json.dumps(event(f"e{i}", f"s{i % 3}", i, "a")) for i in range(9)))
    stream_upsert(spark, str(feed), store, str(tmp_path / "cp")).awaitTermination()
    (feed / "2.json").write_text(json.dumps(event("e1", "s1", 1, "b")) + "\n" + json.dumps(event("n", "s9", 1, "c")))
    stream_upsert(spark, str(feed), store, str(tmp_path / "cp")).awaitTermination()
    got = {r.id: r.text for r in archive.read_archive(spark, store).collect()}
    assert len(got) == 10 and got["e1"] == "b" and got["n"] == "c"
    now = archive.read_archive(spark, store).drop("p")
    assert maintain.fingerprint(now).first() == maintain.fingerprint(now.repartition(5)).first()
    legacy = tmp_path / "events.jsonl"
    legacy.write_text(json.dumps(event("e", "s", 1, "a")) + "\n{broken\n")
    (tmp_path / "sessions.jsonl").write_text(json.dumps({"id": "s"}) + "\n" + json.dumps({"id": "t"}) + "\n")
    for _ in range(2):
        r = archive.migrate(spark, str(legacy), str(tmp_path / "sessions.jsonl"), str(tmp_path / "new")).first()
        assert (r.events_before, r.events_after, r.bad_lines, r.empty_sessions, r.coherent) == (1, 1, 1, 1, True)
    assert schema


def test_archive_moves_rows_between_sessions(spark, tmp_path):
    event = lambda i, s, text: (i, s, 1, "user", text, "pi")
    schema, store = "id string, sessionId string, ts bigint, role string, text string, source string", str(tmp_path / "store")
    archive.write_events(spark, spark.createDataFrame([event("a", "s1", "x"), event("b", "s2", "x")], schema), store, exists=False)
    archive.write_events(spark, spark.createDataFrame([event("a", "s3", "y"), event("a", "s3", "y")], schema), store)
    assert sorted((r.id, r.sessionId, r.text) for r in archive.read_archive(spark, store).collect()) == [("a", "s3", "y"), ("b", "s2", "x")]


def test_prefixes_of_digits_stay_text(spark, tmp_path):
    import hashlib

    keys = [k for k in map(str, range(2000)) if hashlib.md5(k.encode()).hexdigest()[:2] in ("05", "12")][:6]
    letters = next(k for k in map(str, range(2000)) if hashlib.md5(k.encode()).hexdigest()[:2] == "a4")
    schema, store = "id string, sessionId string, ts bigint, role string, text string, source string", str(tmp_path / "store")
    rows = lambda ks, t: spark.createDataFrame([(k, k, 1, "user", t, "pi") for k in ks], schema)
    archive.write_events(spark, rows(keys, "x"), store, exists=False)
    archive.write_events(spark, rows([*keys[:3], letters], "y"), store)
    assert sorted((r.id, r.text) for r in archive.read_archive(spark, store).collect()) == sorted([(k, "y") for k in [*keys[:3], letters]] + [(k, "x") for k in keys[3:]])


def test_file_fingerprint_ignores_order_and_hidden_files(spark, tmp_path):
    for folder, names in (("one", "ab"), ("two", "ba")):
        (tmp_path / folder / "root").mkdir(parents=True)
        for n in names:
            (tmp_path / folder / "root" / f"{n}.txt").write_text(n)
    (tmp_path / "two" / "root" / "_x.txt").write_text("left out")
    marks = [maintain.file_fingerprint(spark, str(tmp_path / f / "root")).first()[0] for f in ("one", "two")]
    (tmp_path / "two" / "root" / "a.txt").write_text("other")
    assert marks[0] == marks[1] != maintain.file_fingerprint(spark, str(tmp_path / "two" / "root")).first()[0]


def test_late_results_and_vanished_files(spark):
    call = lambda i: {"type": "toolCall", "id": i, "name": "bash", "arguments": {"command": i}}
    bash = lambda i, o: line("message", i, message={"role": "bashExecution", "output": o, "exitCode": 0})
    lines = [line("session", "u", cwd="/x"), said("a", "assistant", [call("c1"), call("c2")]), bash("x1", "first"), bash("x2", "second"), said("r", "toolResult", [{"type": "text", "text": "late"}], toolCallId="c2"), bash("x3", "lone")]
    df = spark.createDataFrame([("f.jsonl", i + 1, t) for i, t in enumerate(lines)], "path string, line_no int, line string")
    (event,) = jsonl.events(df).collect()
    # the late result displaces the run that had been attached to c2
    assert [(c.cmd, c.rawRef) for c in event.toolCalls] == [("c1", "pi:u:x2"), ("c2", "pi:u:r")]
    assert sorted(r.id for r in jsonl.orphans(jsonl.messages(df)).collect()) == ["pi:u:x1", "pi:u:x3"]


def test_scan_of_outputs(spark, monkeypatch):
    raw = spark.createDataFrame([("b", "one\n\t The NEEDLE is here \nneedle"), ("a", "x İ needle"), ("pi:c", "Needle\nother"), ("d", None)], "part_id string, content string")
    needles = spark.createDataFrame([("n1", "needle"), ("n2", "NEEDLE is"), ("n3", " "), ("n4", "absent"), ("n5", "needle")], "nid string, needle string")
    rows = lambda df: sorted((r.nid, r.part_id, r.line_no, r.line) for r in df.collect())
    every = [("a", 1, "x İ needle"), ("b", 2, "The NEEDLE is here"), ("pi:c", 1, "Needle")]
    want = sorted([("n1", *e) for e in every] + [("n5", *e) for e in every] + [("n2", "b", 2, "The NEEDLE is here")])
    assert rows(search.raw_scan(needles, raw)) == want
    monkeypatch.setattr(search, "NEEDLES", 1)  # several passes find the same
    assert rows(search.raw_scan(needles, raw)) == want
    monkeypatch.undo()
    assert [r[1] for r in rows(search.raw_scan(needles.limit(1), raw, limit=2))] == ["a", "b"]
    refs = spark.createDataFrame([("pi:c", 9), ("b", 3)], "raw_ref string, ts bigint")
    assert [r[1] for r in rows(search.raw_scan(needles.limit(1), raw, refs, limit=1))] == ["b"]
    assert [r[1] for r in rows(search.raw_scan(needles.limit(1), raw, refs, "pi"))] == ["pi:c"] and rows(search.raw_scan(needles, raw, refs, "none")) == []


def test_filters_take_signs_of_sessions_literally(spark):
    docs = docs_of(spark, [("a", "s%_x", 1, "user", "t", ""), ("b", "sxyx", 2, "user", "t", ""), ("S%_", "S%_", 3, "title", "t", "")])
    ids = lambda **w: sorted(r.id for r in docs.where(columns.filters(**w)).collect())
    assert ids(session="s%_") == ["S%_", "a"] and ids(before=2) == ["a", "b"] and ids(after=0, before=0) == [] and ids(source="all", role="title") == ["S%_"] and ids(agent="x") == []


def test_questions_are_checked(spark):
    docs = docs_of(spark, [("m1", "s1", 1, "user", "What is  the state\nof the proxy ?", ""), ("m2", "s1", 2, "assistant", "What is the state of the proxy?", "")])
    sessions = spark.createDataFrame([("s1",)], "id string")
    sample = spark.createDataFrame([("q1", "s1", "m1", "<system-reminder>a\nb</system-reminder>What is the state of the proxy?"), ("q2", "s1", "m2", "What is the state of the proxy?"), ("q3", "s9", "m1", "x"), ("q4", "s1", "m1", "What is the state of the proxy? Invented.")], "qid string, session_id string, id string, question string")
    good = (None, ["a", "b"], "fait", "high", True)
    rows = [("q1", *good), ("q2", *good), ("q3", *good), ("q4", *good), ("q5", *good), ("q1", "the proxy? In short", ["a", "b"], "fait", "low", True), ("q1", "the proxy?", ["a", ""], "fact", None, None)]
    curated = spark.createDataFrame(rows, "qid string, q string, expect array<string>, type string, specificity string, self_contained boolean")
    found = sorted((r.qid, tuple(r.problems)) for r in evaluate.validate_questions(curated, sample, docs, sessions).collect())
    assert found == sorted([
        ("q1", ()), ("q1", ("rewritten from another beginning",)), ("q1", ("fewer than two facts, or a blank one", "unknown type", "unknown specificity", "self_contained is missing")),
        ("q2", ("no user message of that id in the session",)), ("q3", ("no such session",)), ("q4", ("the archive has another text",)), ("q5", ("not in the sample",)),
    ])


LIST = [("answers", r"\bquestions\.(?:jsonl|md)\b|\beval/", True), ("db", r"\b\w+\.db\b", False), ("folder", r"\barchive/corpus\b", False), ("log", r"\b(?:events|sessions)\.jsonl", False), ("sqlite", r"(?<!['\"])\bsqlite3?\b", False)]
TOOL = evaluate.Tool("arch", ("ingest", "refresh"), ("--corpus", "--limit"))
#: A command, the patterns found in it, and the reasons for review.
AUDITED = [
    ("cat /root/archive/corpus/events.jsonl | python3 -c 'x=1'", {"log", "folder"}, set()), ("grep arch events.jsonl", {"log"}, set()), ('arch "events.jsonl" --limit 5', set(), set()), ('arch search "ingest"', set(), set()), ("arch --json read s --tail 20", set(), set()),
    ("arch refresh-free-zone", set(), set()), ('arch "ingest"', {"change"}, set()), ("arch 'refresh'", {"change"}, set()), ("echo ok && arch ingest > /tmp/x", {"change"}, set()), ("VAR=1 sudo env A=b /usr/bin/arch ingest", {"change"}, set()), ('for q in "a" "b"; do arch "$q" --json; done', set(), {"variable subcommand"}),
    ("arch read s < events.jsonl", {"log"}, set()), ("arch status 2>&1 | head -5", set(), set()), ("arch read s > /tmp/out.txt", set(), set()), ("arch search proxy < eval/questions.jsonl", {"answers"}, set()), ('arch search "questions.jsonl"', set(), set()), ("arch read s /data/events.jsonl", {"log"}, set()),
    ("arch --corpus /tmp/archive/corpus refresh", {"change", "folder"}, set()), ("arch --corpus=/tmp/archive/corpus read s", set(), {"option with a path"}), ("$(which arch) read s", set(), {"substitution"}), ("xargs arch read", set(), {"dynamic command"}), ("eval $CMD", set(), {"dynamic command"}),
    ("grep 'sqlite leur' notes.md", set(), set()), ("node -e \"const D=require('sqlite3'); open\"", set(), set()), ("sqlite3 -c 'select 1' index.db", {"sqlite", "db"}, set()), ("cat sessions.jsonl source.db", {"log", "db"}, set()),
]


SPLIT = [
    ("a 'b;c' \"d|e\" f\\;g", [["a", "'b;c'", '"d|e"', "f\\;g"]]), ("x=1 y && z || w; v & u", [["x=1", "y"], ["z"], ["w"], ["v"], ["u"]]), ("a 2>&1 >out <in | b", [["a", "2>&", "1", ">", "out", "<", "in"], ["b"]]),
    ("if a; then b; fi", [["if", "a"], ["then", "b"], ["fi"]]), ("echo 'open quote; x", [["echo", "'open quote; x"]]), ("(a) $(b c)\nd", [["a"], ["b", "c"], ["d"]]), ("a$b ${c} $", [["a$b", "${c}", "$"]]), ("  ;; ", []),
]
NAMES = [("sudo -n env A=1 /usr/bin/arch read", "command", "arch"), ("'arch' x", "command", "arch"), ("while nice arch; do", "command", "arch"), ("done", "control", ""), ("for x in a", "control", ""), ("$X a", "dynamic", ""), ("time xargs a", "dynamic", "xargs"), ("A=1", "control", ""), ("a\\ b c", "command", "a b")]


def test_commands_are_read_as_a_shell_does(spark):
    df = spark.createDataFrame([(str(i), c) for i, (c, _) in enumerate(SPLIT)], "id string, command string")
    found = {}
    for r in evaluate.command_segments(df).orderBy("id", "segment").collect():
        found.setdefault(int(r.id), []).append(list(r.part))
    assert [found.get(i, []) for i in range(len(SPLIT))] == [parts for _, parts in SPLIT]
    df = spark.createDataFrame([(str(i), c) for i, (c, _, _) in enumerate(NAMES)], "id string, command string")
    kinds = {int(r.id): (r.kind, r.name) for r in evaluate.command_segments(df).where("segment = 0").collect()}
    assert [(c, kinds[i][0], kinds[i][1] if k == "command" else n) for i, (c, k, n) in enumerate(NAMES)] == NAMES


def test_commands_without_quotes_are_cut_at_once(spark):
    """Their tokens are those that the grammar of tokens gives, which commands with a quote go through."""
    rng = random.Random(3)
    plain = ["".join(rng.choice("ab1.=-$(){}|&;\n\t \x0b\u00a0\u00e9") for _ in range(rng.randrange(1, 40))) for _ in range(400)] + ["$$(a)$", " ", "\n", "a$", "$(", "2 > 1", "a\\ b"]
    rows = [(f"{i}-{k}", c + end) for i, c in enumerate(plain) for k, end in enumerate(("", "\n''"))]
    found = {}
    for r in evaluate.command_segments(spark.createDataFrame(rows, "id string, command string")).orderBy("id", "segment").collect():
        found.setdefault(r.id, []).append((list(r.part), r.simple))
    for i, c in enumerate(plain):
        one, two = found.get(f"{i}-0", []), found[f"{i}-1"]
        assert [p for p, _ in one] == [p for p, _ in two][:-1] and two[-1][0] == ["''"]
        assert {s for _, s in one} <= {not set(c) & set("'\"\\<>")} and not any(s for _, s in two)


def test_long_quotes(spark):
    """A quote that is left open, or many in a row, take no stack."""
    cases = ['say "' + "a b " * 30000, 'say "a' + '\\"b ' * 30000 + '" c', "say " + "'a'" * 30000 + "\\x" * 30000]
    df = spark.createDataFrame(list(enumerate(cases)), "id bigint, command string")
    assert {r.id: [len(x) for x in r.part] for r in evaluate.command_segments(df).collect()} == {0: [3, 120001], 1: [3, len(cases[1]) - 6, 1], 2: [3, 150000]}


def test_audit_of_commands(spark):
    commands = spark.createDataFrame([(str(i), 0, c) for i, (c, _, _) in enumerate(AUDITED)], "id string, call_index int, command string")
    deviations, review, _ = evaluate.audit_calls(commands, LIST, TOOL)
    found, doubts = {}, {}
    for r in deviations.collect():
        found.setdefault(int(r.id), set()).add(r.pattern)
    for r in review.collect():
        doubts.setdefault(int(r.id), set()).add(r.reason)
    for i, (command, patterns, reasons) in enumerate(AUDITED):
        assert (command, found.get(i, set()), doubts.get(i, set())) == (command, patterns, reasons)


def test_audit(spark):
    rows = [
        ("a", [("bash", json.dumps({"input": {"command": "cat x | sqlite3 my.db"}}))]), ("b", [("bash", '{"input": {"filePath": "eval/questions.md')]), ("c", [("bash", "echo \"see my sqlite db now\"; eval $(x)"), ("bash", "")]),
        ("d", [("bash", json.dumps("cat events.jsonl")), ("bash", '{"output": "sqlite3"}')]), ("e", [("bash", '{"args": {"cmd": "echo \\"a\\"\\n sqlite3 x", "co')]), (None, None),
    ]
    responses = spark.createDataFrame(rows, "id string, toolCalls array<struct<tool:string,input:string>>")
    commands = evaluate.call_commands(responses)
    got = {(r.id, r.call_index): (r.origin, r.command) for r in commands.collect()}
    assert got == {("a", 0): ("field", "cat x | sqlite3 my.db"), ("b", 0): ("salvage", "eval/questions.md"), ("c", 0): ("text", 'echo "see my sqlite db now"; eval $(x)'), ("c", 1): ("unreadable", None), ("d", 0): ("text", "cat events.jsonl"), ("d", 1): ("unreadable", None), ("e", 0): ("salvage", 'echo "a"\n sqlite3 x')}
    deviations, review, lost = evaluate.audit_calls(commands, LIST)
    assert sorted((r.id, r.pattern, r.invalidating) for r in deviations.collect()) == [("a", "db", False), ("a", "sqlite", False), ("b", "answers", True), ("d", "log", False), ("e", "sqlite", False)]
    assert sorted((r.id, r.reason) for r in review.collect()) == [("c", "dynamic command"), ("c", "substitution")]
    status = evaluate.audit_status(responses, deviations, lost).first()
    assert status.asDict() == {"scanned": 5, "calls": 7, "unreadable": 1, "deviating": 4, "invalid": 1, "unanalysable": 2, "status": "incomplete"}


def test_best_hits_equal_all_scores(spark):
    import random

    rng = random.Random(9)
    words = [f"w{i}" for i in range(200)]
    weights = [1 / (i + 1) for i in range(200)]
    rows = [(f"d{i:04}", "s", i, "user", " ".join(rng.choices(words, weights, k=rng.randrange(1, 60))), rng.choice(["", "w1 w2", "x.y"])) for i in range(600)]
    docs = docs_of(spark, rows)
    queries = spark.createDataFrame([(f"q{i}", " ".join(rng.choices(words, k=rng.randrange(1, 25))) + rng.choice(["", " w1.w2", " x.y"])) for i in range(40)], "qid string, q string")
    for k in (1, 5, 700):
        want = textindex.top_k(textindex.bm25(queries, docs), k)
        got = search.ranked(queries, docs, k)
        rows_of = lambda df: sorted((r.qid, r.rank, r.id, r.score) for r in df.collect())
        assert rows_of(got) == rows_of(want)
    some = docs.where("ts % 7 = 3")
    want = textindex.top_k(textindex.bm25(queries, docs).join(some.select("id"), "id", "left_semi"), 5)
    assert rows_of(search.ranked(queries, docs, 5, columns.F.col("ts") % 7 == 3)) == rows_of(want)
    effort = search.search_effort(queries, docs, 5).agg({"matching": "sum", "summed": "sum"}).first()
    assert effort[0] != effort[1] and min(effort) < max(effort)


def test_an_old_index_is_refused(spark, tmp_path):
    docs = docs_of(spark, [("a", "s", 1, "user", "one two", ""), ("b", "s", 2, "user", "two three", "")])
    path = str(tmp_path / "index")
    textindex.write_index(docs, path)
    assert textindex.current_index(docs, path)["stats"].count() == 2
    changed = docs.where("id = 'a'").withColumn("text", columns.F.lit("other two"))
    after = maintain.upsert(docs, changed)
    with pytest.raises(ValueError, match="isn't that of the archive: opencode differs"):
        textindex.current_index(after, path)
    textindex.add_segment(changed, path)
    queries = spark.createDataFrame([("q1", "one"), ("q2", "other"), ("q3", "two")], "qid string, q string")
    hits = lambda d: {(r.qid, r.id) for r in search.ranked(queries, d, 5, **textindex.current_index(d, path)).collect()}
    assert hits(after) == {("q2", "a"), ("q3", "a"), ("q3", "b")}
    textindex.add_segment(docs.limit(0), path, gone=docs.where("id = 'b'"))
    left = after.where("id = 'a'")
    assert hits(left) == {("q2", "a"), ("q3", "a")}
    textindex.merge_segments(spark, path)
    assert hits(left) == {("q2", "a"), ("q3", "a")} and textindex._segments(spark, path) == [3]


def test_tables_by_jdbc(spark):
    """Against the embedded database that comes with Spark: ranges of the update time, and conditions in the database."""
    from dialogmill.sources import relational

    jdbc = {"url": "jdbc:derby:memory:shop;create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    part = spark.range(400).selectExpr("concat('p', id) AS id", "concat('m', id div 2) AS message_id", "id * 10 AS time_updated", "if(id % 7 = 0, '{broken', '{}') AS data")
    message = spark.range(200).selectExpr("concat('m', id) AS id", "'s' AS session_id", "id * 20 AS time_updated", "'{}' AS data")
    for name, rows in (("part", part), ("message", message), ("session", message.where("time_updated = 40"))):
        rows.write.format("jdbc").options(**jdbc, dbtable=name).mode("overwrite").save()
    found = relational.read_messages(spark, "", 1000, jdbc=jdbc)
    assert found.count() == 149 and relational.read_messages(spark, "", 1000, inclusive=True, jdbc=jdbc).count() == 150
    assert found.rdd.getNumPartitions() == relational.PARTS
    plan = found._jdf.queryExecution().executedPlan().toString().upper()
    assert "PUSHEDFILTERS" in plan and "GREATERTHAN(TIME_UPDATED,1000)" in plan
    assert relational.read_parts(spark, "", found, jdbc=jdbc).count() == sum(i % 7 != 0 and i // 2 > 50 for i in range(400))
    assert relational.read_sessions(spark, "", jdbc=jdbc).count() == 1


def test_flat_outputs_are_moved_once(spark, tmp_path):
    flat = tmp_path / "flat"
    flat.mkdir()
    files = {"a|b": "é\n", "pi:u:r1": "x", "c d+%": "z"}
    for name, text in files.items():
        (flat / f"{name}.txt").write_text(text)
    (flat / "other.log").write_text("no")
    counts = [archive.migrate_raw(spark, str(flat), str(tmp_path / "raw"), exists=turn > 0).first() for turn in range(2)]
    assert [tuple(c) for c in counts] == [(3, 3, 3), (3, 3, 0)]
    (flat / "pi:u:r1.txt").write_text("changed")
    assert tuple(archive.migrate_raw(spark, str(flat), str(tmp_path / "raw"), exists=True).first()) == (3, 3, 1)
    assert {r.part_id: (r.content, r.source) for r in archive.read_archive(spark, str(tmp_path / "raw")).collect()} == {"a|b": ("é\n", "opencode"), "pi:u:r1": ("changed", "pi"), "c d+%": ("z", "opencode")}


def test_phrase_of_terms_that_occur_unequally_often(spark):
    docs = spark.createDataFrame([("a", "run 7 also 7", "7"), ("b", "also", "7 also 7 also 8"), ("c", "7 also", "also 8 7")], "id string, text string, cmd string")
    asked = spark.createDataFrame([("q", "also-7")], "qid string, q string")
    found = textindex.long_phrases(textindex.phrases(asked).withColumn("bucket", textindex.bucket()), textindex.postings(docs))
    assert sorted((r.id, r.tf) for r in found.collect()) == [("a", 1), ("b", 1)]


def test_summary_of_an_audit_tells_all_patterns_apart(spark):
    calls = ["cat source.db", "cat index.sqlite", "sqlite3 my.db", "cat events.jsonl", "cat sessions.jsonl", "ls archive/raw", "cat curated.json", "archivist refresh"]
    commands = spark.createDataFrame([("r", n, c) for n, c in enumerate(calls)], "id string, call_index int, command string")
    deviations = evaluate.audit_calls(commands, catalog.records.WHOLE_AUDIT, catalog.TOOL)[0]
    assert {r.pattern for r in evaluate.audit_summary(deviations, catalog.records.WHOLE_AUDIT).collect()} == {"source-database", "index-database", "database-shell", "event-log", "session-log", "archive-folder", "test-set", "change"}
    assert {r.pattern for r in catalog.queries()["audit_summary"](spark, SF).collect()} == {"database-shell", "change", "event-log", "test-set", "session-log"}


def test_search_of_kept_documents_sums_no_others(spark):
    docs = spark.createDataFrame([(f"d{n:03d}", "alpha beta" if n % 3 else "alpha", "", n, "user" if n % 50 else "title") for n in range(400)], "id string, text string, cmd string, ts bigint, role string")
    asked = spark.createDataFrame([("q", "alpha beta")], "qid string, q string")
    _, pairs = textindex.scores(asked, docs).best(3, docs.where("role = 'title'").select("id"))
    assert {r.id for r in pairs.select("id").distinct().collect()} <= {f"d{n:03d}" for n in range(0, 400, 50)}
    assert [r.id for r in search.ranked(asked, docs, 3, docs["role"] == "title").orderBy("rank").collect()] == ["d050", "d100", "d200"]
    first = search.by_time(asked, docs, 3, newest=False, where=docs["role"] == "title").orderBy("rank")
    assert [(r.rank, r.id) for r in first.collect()] == [(1, "d000"), (2, "d050"), (3, "d100")]
    whole = textindex.scores(asked, docs).first(3, docs.select("id", "ts"), ["ts", "id"])
    assert sorted(r.id for r in whole.collect()) == ["d000", "d001", "d002"]


def test_search_writes_no_pairs_of_queries_and_documents(spark, monkeypatch):
    """each document is asked for with its whole text, so nearly all pairs match; ties stand in several blocks."""
    import random

    rng = random.Random(4)
    texts = [" ".join(rng.choices(["a1", "b2", "c3", "d4", "e5", "f6.g7"], k=rng.randrange(3, 9))) for _ in range(60)] * 2
    docs = docs_of(spark, [(f"d{i:03}", f"s{i}", i, "user", x, "") for i, x in enumerate(texts)])
    asked = docs.selectExpr("session_id AS qid", "text AS q", "array(session_id) AS expect", "false AS known_miss")
    want = textindex.top_k(textindex.bm25(asked, docs), 5).join(docs.select("id", "session_id"), "id").where("qid = session_id").groupBy("qid").agg({"rank": "min"})
    want = {r[0]: r[1] for r in want.collect()}
    held, written = textindex.staged, []
    monkeypatch.setattr(textindex, "staged", lambda df, name="staged": (lambda done: written.append(done.count()) or done)(held(df, name)))
    monkeypatch.setattr(textindex.Scores, "MET", 100, raising=False)
    got = {r.qid: (r.top1, r.top3, r.top5) for r in search.eval_topk(asked, docs).collect()}
    assert got == {f"s{i}": tuple(want.get(f"s{i}", 9) <= k for k in (1, 3, 5)) for i in range(120)}
    assert max(written) < 120 * 20


def test_needle_is_looked_for_once(spark, monkeypatch):
    """what leaves the tasks doesn't grow with the rows that ask for a needle."""
    given, held = [], search._scanner
    monkeypatch.setattr(search, "_scanner", lambda words, limit: given.append(len(words)) or held(words, limit))
    needles = spark.createDataFrame([(f"n{i}", "OUT" if i % 2 else "out") for i in range(50)], "nid string, needle string")
    raw = spark.createDataFrame([("a", "x\nan out"), ("b", "Out 2"), ("c", "none")], "part_id string, content string")
    found = sorted((r.nid, r.part_id, r.line_no, r.line) for r in search.raw_scan(needles, raw, limit=1).collect())
    assert found == sorted((f"n{i}", "a", 2, "an out") for i in range(50)) and given == [1]
