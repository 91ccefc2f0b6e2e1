"""Search over the archive: ranked, by time, with neighbours, excerpts, groups, and scans of raw outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dialogmill.functions.columns import trimmed
from dialogmill.operators.textindex import phrases, scores, tokenize, top_k
from dialogmill.sources.staging import staged

EXCERPT = 20_000
#: Needles that one pass over the outputs looks for; they are collected to the driver and sent to the tasks.
NEEDLES = 50_000


def ranked(queries: DataFrame, docs: DataFrame, k: int, where: Column | None = None, **index) -> DataFrame:
    """(qid, rank, id, score and the document's columns): filters come before the limit, statistics cover all documents."""
    kept = docs if where is None else docs.where(where)
    return top_k(scores(queries, docs, **index).top(k, None if where is None else kept), k).join(kept, "id")


def search_effort(queries: DataFrame, docs: DataFrame, k: int, **index) -> DataFrame:
    """(qid, matching, summed): pairs of a phrase and a document that has it, and how many of them a search for the best k sums."""
    found = scores(queries, docs, **index)
    _, pairs = found.best(k)
    summed = pairs.groupBy("qid").agg(F.sum("pairs").alias("summed"))
    every = found.summed(found.terms).groupBy("qid").agg(F.sum("pairs").alias("matching"))
    return every.join(summed, "qid", "left").select("qid", "matching", F.coalesce("summed", F.lit(0)).alias("summed"))


def by_time(queries: DataFrame, docs: DataFrame, k: int, newest: bool = True, where: Column | None = None, **index) -> DataFrame:
    """The first k of all matches in order of (ts, id), both descending for newest; texts join the chosen ones only."""
    kept = docs if where is None else docs.where(where)
    order = [F.col("ts").desc(), F.col("id").desc()] if newest else ["ts", "id"]
    return scores(queries, docs, **index).first(k, kept.select("id", "ts"), order).join(kept, "id")


def browse(docs: DataFrame, n: int, newest: bool = True, where: Column | None = None) -> DataFrame:
    """Messages without keywords; titles never, empty texts too."""
    kept = docs.where(F.col("role").isin("user", "assistant"))
    kept = kept if where is None else kept.where(where)
    order = [F.col("ts").desc(), F.col("id").desc()] if newest else ["ts", "id"]
    return kept.orderBy(*order).limit(n)


def with_sessions(hits: DataFrame, sessions: DataFrame) -> DataFrame:
    return hits.join(sessions.select(F.col("id").alias("session_id"), F.col("title").alias("session_title"), F.col("repo").alias("session_repo")), "session_id", "left")


def neighbors(hits: DataFrame, docs: DataFrame, ctx: int) -> DataFrame:
    """(qid, session_id, id, ts, for_ref): ctx messages before and after each hit (qid, rank, id, session_id, ts, role).

    Titles are no messages: a title hit stands before the first message at or after it. A message near several hits of
    a query is there once, for the first of them. Only sessions with hits are numbered, once; the places around a hit meet
    the messages by an equi-join. hits are read several times: a search's result should be written first.
    """
    asked = hits.select("session_id").distinct()
    events = docs.where("role <> 'title'").join(asked, "session_id", "left_semi").select("session_id", "id", "ts", F.lit(1).alias("message"))
    titles = hits.where("role = 'title'").select("session_id", "id", "ts").distinct().withColumn("message", F.lit(0))
    # one order of messages and title hits: a message's number, and the number of messages before a title, are running counts
    order = W.partitionBy("session_id").orderBy("ts", "id", "message").rowsBetween(W.unboundedPreceding, 0)
    placed = staged(events.unionByName(titles).withColumn("rn", F.sum("message").over(order)), "places")
    numbered = placed.where("message = 1").select("session_id", "id", "ts", "rn")
    mine = hits.select("qid", "rank", "id", "session_id", (F.col("role") != "title").cast("int").alias("message")).join(placed.select("session_id", "id", "message", "rn"), ["session_id", "id", "message"])
    # positions around a hit; a title stands between two messages
    around = F.when(F.col("message") == 1, F.filter(F.sequence(F.col("rn") - ctx, F.col("rn") + ctx), lambda x: x != F.col("rn"))).otherwise(F.sequence(F.col("rn") + 1 - ctx, F.col("rn") + ctx))
    spans = mine.select("qid", "rank", F.col("id").alias("for_ref"), "session_id", F.explode(around).alias("rn"))
    near = spans.join(numbered, ["session_id", "rn"])
    first = F.row_number().over(W.partitionBy("qid", "session_id", "id").orderBy("rank"))
    return near.withColumn("n", first).where("n = 1").select("qid", "session_id", "id", "ts", "for_ref")


def session_groups(hits: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """(qid, session_id, best_rank, hit_refs, n_hits): groups by their best hit, hits by time within.

    With near (of neighbors) also neighbor_refs: the messages around the hits that are no hits, by time.
    """
    refs = lambda: F.transform(F.array_sort(F.collect_list(F.struct("ts", "id"))), lambda x: x["id"])
    groups = hits.groupBy("qid", "session_id").agg(F.min("rank").alias("best_rank"), refs().alias("hit_refs"), F.count("*").alias("n_hits"))
    if near is None:
        return groups
    around = near.join(hits.select("qid", "id"), ["qid", "id"], "left_anti").groupBy("qid", "session_id").agg(refs().alias("neighbor_refs"))
    return groups.join(around, ["qid", "session_id"], "left").withColumn("neighbor_refs", F.coalesce("neighbor_refs", F.array().cast("array<string>")))


def missing_models(hits: DataFrame) -> DataFrame:
    return hits.groupBy("qid").agg(F.count_if((F.col("role") == "assistant") & F.col("model").isNull()).alias("missing_models"))


def totals(hits: DataFrame, k: int) -> DataFrame:
    """How many hits there are, known only below the limit."""
    n = F.count("*")
    return hits.groupBy("qid").agg(n.alias("shown"), F.when(n < k, n).alias("total"))


def excerpts(hits: DataFrame, limit: int = EXCERPT) -> DataFrame:
    """hits with excerpt, excerpt_len, full_len, full; hits found only by a command show the command."""
    body = F.when(F.coalesce(F.col("text"), F.lit("")) != "", F.col("text")).otherwise(F.coalesce(F.col("cmd"), F.lit("")))
    cut = F.substring(body, 1, limit)
    return hits.withColumns({"excerpt": cut, "excerpt_len": F.length(cut), "full_len": F.length(body), "full": F.length(cut) == F.length(body)})


def snippets(hits: DataFrame, queries: DataFrame, width: int = 14, column: str = "text", marks: tuple[str, str] = ("[", "]")) -> DataFrame:
    """hits with <column>_snippet and <column>_marked: the window of `width` words with most different query terms.

    The earliest of these; marked has the words with a query term between marks. Also for commands (column="cmd").
    """
    asked = phrases(queries).groupBy("qid").agg(F.collect_set("term").alias("asked"))
    words = F.split(trimmed(F.coalesce(column, F.lit(""))), r"\s+")
    joined = hits.join(asked, "qid", "left").withColumn("words__", words)
    found = joined.withColumn("hit__", F.transform("words__", lambda w: F.array_intersect(tokenize(w), F.coalesce("asked", F.array().cast("array<string>")))))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words__") - width + 1, F.lit(1)))
    best = F.array_max(F.transform(starts, lambda i: F.struct(F.size(F.array_distinct(F.flatten(F.slice("hit__", i, F.lit(width))))).alias("n"), (-i).alias("i"))))
    at = F.col("at__")
    dots = lambda c: F.when(c, F.lit("...")).otherwise(F.lit(""))
    shown = lambda ws: F.concat(dots(at > 1), F.array_join(F.slice(ws, at, F.lit(width)), " "), dots(at + width <= F.size("words__")))
    marked = F.zip_with("words__", "hit__", lambda w, h: F.when(F.size(h) > 0, F.concat(F.lit(marks[0]), w, F.lit(marks[1]))).otherwise(w))
    placed = found.withColumn("at__", -best["i"])
    return placed.withColumns({f"{column}_snippet": shown(F.col("words__")), f"{column}_marked": shown(marked)}).drop("words__", "hit__", "asked", "at__")


def rawrefs(events: DataFrame) -> DataFrame:
    """One row for each raw output that a call of an event refers to; the last event wins."""
    calls = events.select(F.col("id").alias("event_id"), F.col("sessionId").alias("session_id"), "ts", "role", F.explode("toolCalls").alias("c")).where("c.rawRef IS NOT NULL")
    last = F.row_number().over(W.partitionBy("c.rawRef").orderBy(F.col("ts").desc(), F.col("event_id").desc()))
    return calls.withColumn("n", last).where("n = 1").select(F.col("c.rawRef").alias("raw_ref"), "event_id", "session_id", "ts", "role", F.col("c.tool").alias("tool"), F.col("c.cmd").alias("cmd"))


def ref_source(raw_ref: Column) -> Column:
    """The source of a raw output, by the family of its id."""
    return F.when(raw_ref.startswith("pi:"), "pi").otherwise("opencode")


def raw_scan(needles: DataFrame, raw: DataFrame, refs: DataFrame | None = None, source: str | None = None, limit: int = 10, line_chars: int = 200) -> DataFrame:
    """(nid, part_id, line_no, line): the first match of each literal needle (nid, needle) in each output, without regard to case.

    At most `limit` outputs for each needle, in order of their id, or of (ts, id) where refs (raw_ref, ts) are given:
    then only outputs that are referred to are read. source keeps one family of ids; an unknown one has no outputs.

    All needles are looked for in one pass over an output, by an automaton of at most NEEDLES of them; more make
    further passes. A needle is looked for once, however many rows ask for it. A task keeps the first `limit` outputs of
    each needle only, so what leaves it doesn't grow with the outputs.
    """
    outputs = raw.select("part_id", "content", F.lit(0).cast("bigint").alias("ts")) if refs is None else raw.select("part_id", "content").join(refs.select(F.col("raw_ref").alias("part_id"), "ts"), "part_id")
    if source not in (None, "all"):
        outputs = outputs.where(ref_source(F.col("part_id")) == source)
    outputs = outputs.select("ts", "part_id", "content", F.lower("content").alias("low"))
    asked = needles.where(trimmed(F.coalesce("needle", F.lit(""))) != "").select("nid", F.lower("needle").alias("needle"))
    wanted = asked.select("needle").distinct()
    n = wanted.count()
    passes = 1 if n <= NEEDLES else -(-2 * n // NEEDLES)
    schema = "needle string, ts bigint, part_id string, line_no int, line string"
    found = None
    for turn in range(passes if n else 0):
        words = [r.needle for r in wanted.where(F.pmod(F.xxhash64("needle"), F.lit(passes)) == turn).collect()]
        if not words:
            continue
        part = outputs.mapInArrow(_scanner(words, limit), schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = needles.sparkSession.createDataFrame([], schema)
    first = F.row_number().over(W.partitionBy("needle").orderBy("ts", "part_id"))
    best = found.withColumn("n__", first).where(F.col("n__") <= limit).join(asked, "needle")
    return best.select("nid", "part_id", "line_no", F.substring(trimmed(F.col("line")), 1, line_chars).alias("line"))


def _scanner(words: list[str], limit: int):
    """The task of raw_scan: a heap of the first outputs for each needle."""

    def run(batches):
        import heapq
        from collections import defaultdict

        import ahocorasick
        import pyarrow as pa

        automaton = ahocorasick.Automaton()
        for needle in words:
            automaton.add_word(needle, needle)
        automaton.make_automaton()
        best: dict[str, list] = defaultdict(list)  # the largest (ts, part_id) is first to go

        class Last(tuple):
            def __lt__(self, other):
                return tuple.__gt__(self, other)

        for batch in batches:
            for ts, part, content, low in zip(*(c.to_pylist() for c in batch.columns)):
                if not low:
                    continue
                seen = {}
                for end, needle in automaton.iter(low):
                    if needle not in seen:
                        seen[needle] = end
                        if len(seen) == len(words):
                            break
                for needle, end in seen.items():
                    row = Last((ts, part))
                    held = best[needle]
                    if len(held) < limit or (ts, part) < tuple(held[0][0]):
                        at = low.count("\n", 0, end - len(needle) + 1)
                        entry = (row, at + 1, content.split("\n")[at])
                        (heapq.heappush if len(held) < limit else heapq.heapreplace)(held, entry)
        out = [(needle, *row, line_no, line) for needle, held in best.items() for row, line_no, line in held]
        columns = list(zip(*out)) or [[]] * 5
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["needle", "ts", "part_id", "line_no", "line"])

    return run


def raw_lookup(ids: DataFrame, raw: DataFrame) -> DataFrame:
    return raw.join(ids, "part_id", "left_semi")


def eval_topk(questions: DataFrame, docs: DataFrame, **index) -> DataFrame:
    """(qid, top1, top3, top5) of a table (qid, q, expect, known_miss): is an expected session among the first k hits?"""
    best = top_k(scores(questions.select("qid", "q"), docs, **index).top(5), 5).join(docs.select("id", "session_id"), "id")
    got = best.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "session_id"))), lambda x: x["session_id"]).alias("got"))
    joined = questions.join(got, "qid", "left").withColumn("got", F.coalesce("got", F.array().cast("array<string>")))
    marks = {f"top{k}": F.arrays_overlap("expect", F.slice("got", 1, k)) for k in (1, 3, 5)}
    return joined.withColumns(marks).select("qid", *marks, "known_miss")
