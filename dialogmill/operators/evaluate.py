"""Evaluation sets and audits: turns, question samples, checks of curated questions, patterns in recorded commands."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dialogmill.functions.columns import trimmed, variant_string

# How a question shows itself, what is no question, and what makes a text concrete. Their word edges are
# those of ASCII, as "où" ends in a letter that is none of \w there; Java's \b knows letters beyond ASCII.
_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
TRIVIAL = r"(?i)^\s*(/(compact|clear|help|init)" + _EDGE + r"|(continue|continuer|ok|okay|oui|non|vas-?y|go|merci|parfait|top)\s*[.!]?$)"
ASKING = r"(?i)\?|" + _EDGE + r"(comment|pourquoi|où|ou est|quel(le|s)?|quand|combien|est-ce que|c'?est quoi|peux-tu|peux tu|tu peux|je voudrais|j'?aimerais|explique|rappelle|retrouve|cherche|vérifie|dis-moi|fais|peut-on|on peut|il y a)" + _EDGE
CONCRETE = r"(?i)(/[A-Za-z0-9_.-]+|\.(js|json|md|db|py|sh|toml|yaml|yml|conf)" + _EDGE + "|" + _EDGE + r"v?[0-9]+\.[0-9]+(\.[0-9]+)?" + _EDGE + r"|`[^`]+`|" + _EDGE + r"[a-z]+_[a-z_]+" + _EDGE + ")"
HELPERS = ["explore", "general", "advisor"]


def turns(docs: DataFrame) -> DataFrame:
    """(session_id, turn, id, ts, question, answers): a user's message and the assistant's texts up to the next one."""
    order = W.partitionBy("session_id").orderBy("ts", "id")
    # any role but the assistant's ends a turn
    numbered = docs.where("role <> 'title'").withColumn("turn", F.sum(F.when(F.col("role") != "assistant", 1).otherwise(0)).over(order))
    head = lambda c: F.max(F.when(F.col("role") == "user", F.col(c)))
    answer = F.when((F.col("role") == "assistant") & (F.coalesce("text", F.lit("")) != ""), F.struct("ts", "id", trimmed(F.col("text")).alias("text")))
    grouped = numbered.where("turn > 0").groupBy("session_id", "turn").agg(head("id").alias("id"), head("ts").alias("ts"), head("text").alias("question"), head("agent").alias("agent"), head("repo").alias("repo"), F.transform(F.array_sort(F.collect_list(answer)), lambda x: x["text"]).alias("answers"))
    return grouped.where(F.col("id").isNotNull() & ~F.coalesce(F.col("agent").isin(HELPERS), F.lit(False))).drop("agent")


def turn_candidates(docs: DataFrame, sessions: DataFrame, asking: str = ASKING, trivial: str = TRIVIAL, concrete: str = CONCRETE) -> DataFrame:
    """Questions worth asking, with their answers and a score from 0 to 9; the first of equal beginnings stays."""
    top = sessions.where("parent_session IS NULL").select(F.col("id").alias("session_id"))
    found = turns(docs.join(top, "session_id", "left_semi")).withColumns({"q": trimmed(F.col("question")), "a": trimmed(F.array_join("answers", "\n\n"))})
    q, a = F.col("q"), F.col("a")
    kept = found.where(F.length(q).between(25, 1200) & ~q.rlike(trivial) & q.rlike(asking) & (F.length(a) >= 200))
    first = F.row_number().over(W.partitionBy(F.substring(q, 1, 120)).orderBy("session_id", "ts", "id"))
    one = lambda c, n: F.when(c, n).otherwise(0)
    score = one(q.endswith("?"), 2) + one(q.rlike(asking), 1) + one(q.rlike(concrete), 1) + one(F.length(a).between(400, 5000), 2) + one(a.rlike(concrete), 2) + one(F.size("answers") == 1, 1)
    return kept.withColumn("n__", first).where("n__ = 1").select("session_id", "id", "ts", "repo", F.length(q).alias("q_len"), F.length(a).alias("a_len"), score.alias("score"), q.alias("question"), a.alias("answer"))


def draw(seed: int, key: str) -> Column:
    """The place of a row in a seeded order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key)))


def turn_sample(candidates: DataFrame, seed: int, least: int = 5, cap: int = 30, n: int = 90) -> DataFrame:
    """n candidates of a score of at least `least` in a seeded order, at most cap from each repo; qid by place."""
    drawn = candidates.where(F.col("score") >= least).withColumn("draw", draw(seed, "id"))
    held = drawn.withColumn("n__", F.row_number().over(W.partitionBy(F.coalesce("repo", F.lit("(global)"))).orderBy("draw", "id"))).where(F.col("n__") <= cap)
    best = held.orderBy("draw", "id").limit(n)  # n rows are numbered
    return best.withColumn("qid", F.format_string("q%03d", F.row_number().over(W.orderBy("draw", "id")))).drop("n__", "draw")


def blind_export(sample: DataFrame, seed: int) -> DataFrame:
    """Questions and their ids only, in a seeded order (place, from 1); a sample has few rows."""
    order = W.orderBy(draw(seed, "qid"), "qid")
    return sample.select("qid", "question").withColumn("place", F.row_number().over(order))


# What clients add to a question, and the closed sets of its tags.
ARTEFACTS = [r"(?s)<system-reminder>.*?</system-reminder>", r"(?m)^\s*Use the above message and context to generate a prompt and call the task tool.*$"]
TYPES, SPECIFICITIES = ("fait", "etat", "decision", "conseil", "veille"), ("high", "medium", "low")
SHORTEST, BEGINNING, FACTS = 10, 40, 2


def comparable(text: Column) -> Column:
    """What a person wrote: without artefacts of clients, white space as one space, none before punctuation."""
    for pattern in ARTEFACTS:
        text = F.regexp_replace(text, pattern, " ")
    return trimmed(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r" (?=[?!;:,.])", ""))


#: Where a question comes from: the first of these that holds is its only problem.
PROVENANCE = {
    "not in the sample": "message_id IS NULL",
    "no such session": "known_session IS NULL",
    "no user message of that id in the session": "message_role IS NULL OR message_role <> 'user' OR message_session <> session_id",
    "the archive has another text": f"length(archived) < {SHORTEST} OR archived <> drawn",
    "too short": f"length(asked) < {SHORTEST}",
}
#: What is said about it: all that hold are listed.
DETAILS = {
    "rewritten from another beginning": f"rewritten <> '' AND NOT contains(drawn, substring(rewritten, 1, {BEGINNING}))",
    "fewer than two facts, or a blank one": f"expect IS NULL OR size(expect) < {FACTS} OR exists(expect, x -> x IS NULL OR NOT x RLIKE '\\\\S')",
    "unknown type": f"type IS NULL OR type NOT IN {TYPES}",
    "unknown specificity": f"specificity IS NULL OR specificity NOT IN {SPECIFICITIES}",
    "self_contained is missing": "self_contained IS NULL",
}


def validate_questions(curated: DataFrame, sample: DataFrame, docs: DataFrame, sessions: DataFrame) -> DataFrame:
    """(qid, problems) of curated (qid, q, expect, type, specificity, self_contained): checked against the sample and the archive."""
    drawn = sample.select("qid", "session_id", F.col("id").alias("message_id"), comparable(F.col("question")).alias("drawn"))
    messages = docs.where("role <> 'title'").select(F.col("id").alias("message_id"), F.col("session_id").alias("message_session"), F.col("role").alias("message_role"), comparable(F.coalesce("text", F.lit(""))).alias("archived"))
    known = sessions.select(F.col("id").alias("session_id"), F.lit(True).alias("known_session"))
    rows = curated.join(drawn, "qid", "left").join(messages, "message_id", "left").join(known, "session_id", "left")
    rows = rows.withColumn("rewritten", comparable(F.coalesce("q", F.lit("")))).withColumn("asked", F.coalesce(F.nullif("rewritten", F.lit("")), "drawn"))
    first = F.coalesce(*(F.when(F.expr(rule), F.array(F.lit(name))) for name, rule in PROVENANCE.items()))
    rest = F.array_compact(F.array(*(F.when(F.expr(rule), F.lit(name)) for name, rule in DETAILS.items())))
    return rows.select("qid", F.coalesce(first, rest).alias("problems"))


def question_items(curated: DataFrame, problems: DataFrame) -> DataFrame:
    """The curated rows if none of them has a problem, else no row at all."""
    wrong = problems.where(F.size("problems") > 0).agg(F.count("*").alias("wrong__"))
    return curated.join(F.broadcast(wrong)).where("wrong__ = 0").drop("wrong__")  # one row


def question_rollup(questions: DataFrame, *dimensions: str) -> DataFrame:
    """(dimension, value, n, first_ts, last_ts, sessions) for each dimension."""
    spread = questions.select("ts", "session_id", F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("?")).alias("value")) for d in dimensions))).alias("x"))
    return spread.groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.countDistinct("session_id").alias("sessions"))


# Fields of a call's input that hold its command, and those looked for in cut-off JSON, in order.
FIELDS = ["command", "cmd", "script", "code", "filePath", "file", "path", "pattern", "query", "url", "content"]
SALVAGED = ["command", "cmd", "script", "code", "filePath", "file", "path", "pattern", "query"]
# The reserved words of the shell command language (POSIX.1-2017, XCU 2.4), in its order; a command follows
# those of the second list. Utilities that invoke another, of the same standard and two common ones; and those whose
# operand can't be read off.
RESERVED = ["!", "{", "}", "case", "do", "done", "elif", "else", "esac", "fi", "for", "if", "in", "then", "until", "while"]
LEADING = ["!", "{", "do", "elif", "else", "if", "then", "until", "while"]
INVOKING, DYNAMIC = ["command", "env", "exec", "nice", "nohup", "time", "stdbuf", "sudo"], [".", "eval", "source", "xargs"]
#: A shell's tokens: redirections, operators between commands, and words with their quoted parts; a quote may be left open. Loops
#: give nothing back, as Java's would take a frame of its stack for each turn.
REDIRECTION = r"\d*(?:<<-?|>>|<>|>\||[<>]&|[<>])"
OPERATOR = r"\$\(|\|\||&&|;;|[|;&()\n]"
WORD = r"(?:\\[\s\S]|'[^']*(?:'|$)|\"[^\"\\]*+(?:\\[\s\S][^\"\\]*+)*+(?:\"|$)|\$(?!\()|[^\s'\"\\|&;()<>$]++)++"


@dataclass(frozen=True)
class Tool:
    """The archive's own command: its name, subcommands that change the archive, and options that take a value."""

    name: str
    changing: tuple[str, ...] = ()
    valued: tuple[str, ...] = ()


def call_commands(responses: DataFrame) -> DataFrame:
    """(id, call_index, tool, command, origin) of responses with toolCalls (tool, input as JSON text, which may be cut off).

    origin: field, salvage (out of JSON that is cut off or has no known field), text, or unreadable (command null).
    """
    calls = responses.select("id", F.posexplode("toolCalls").alias("call_index", "c")).select("id", "call_index", F.col("c.tool").alias("tool"), F.coalesce("c.input", F.lit("")).alias("input")).withColumn("v", F.try_parse_json("input"))
    v, none = F.col("v"), F.lit("")
    field = F.coalesce(*(F.nullif(variant_string(v, f"{root}.{k}"), none) for root in ("$.input", "$.args") for k in FIELDS))
    cut = F.regexp_extract("input", rf'"(?:{"|".join(SALVAGED)})"\s*:\s*"((?:[^"\\]|\\.)*)', 1)
    for escape, sign in (("n", "\n"), ("t", "\t"), ("r", "\r")):
        cut = F.regexp_replace(cut, rf"(?<!\\)((?:\\\\)*)\\{escape}", f"$1{sign}")
    salvage = F.nullif(trimmed(F.regexp_replace(cut, r"\\(.)", "$1")), none)
    plain = F.when(F.schema_of_variant(v) == "STRING", F.nullif(F.try_variant_get(v, "$", "string"), none)).when(~F.col("input").rlike(r"^\s*[{\[]"), F.nullif(F.col("input"), none))
    origin = F.when(field.isNotNull(), "field").when(plain.isNotNull(), "text").when(salvage.isNotNull(), "salvage").otherwise("unreadable")
    return calls.select("id", "call_index", "tool", F.coalesce(field, plain, salvage).alias("command"), origin.alias("origin"))


def unquoted(word: Column) -> Column:
    """A word without its quotes and escapes."""
    return F.regexp_replace(F.regexp_replace(word, r"\\(.)", "$1"), "[\"']", "")


def masked(word: Column) -> Column:
    """A word that is one quoted phrase of several words, without signs or words of code, as empty quotes."""
    phrase = word.rlike(r"^(?:'[^']*\s[^']*'?|\"[^\"]*\s[^\"]*\"?)$") & ~word.rlike(r"[=(){};|<>$`]|\b(?:import|require|from|def|open|connect)\b")
    return F.when(phrase, F.concat(F.substring(word, 1, 1), F.substring(word, 1, 1))).otherwise(word)


def command_segments(commands: DataFrame, tool: Tool | None = None) -> DataFrame:
    """commands with a row for each simple command: segment, part (its tokens), kind, name, subcommand, opened, named, values.

    A command is read as a shell does: tokens, cut at operators; then redirections with their targets, assignments and words
    that a command follows are set aside, and what comes next is its name. kind: command, control (a reserved word) or
    dynamic (what runs can't be known). For the archive's own tool also its subcommand, files that redirections open, paths among
    its arguments (named), and values of its options. simple tells that a command has no quotes, escapes or redirections: its
    tokens are what lies between white space and operators, and are cut at once.
    """
    simple = ~F.col("command").rlike(r"['\"\\<>]")
    tokens = F.when(~F.col("simple"), F.regexp_extract_all("command", F.lit(f"{REDIRECTION}|{OPERATOR}|{WORD}"), F.lit(0)))
    listed = commands.withColumn("simple", simple).select("*", tokens.alias("tokens"))
    cuts = F.filter(F.sequence(F.lit(1), F.size("tokens") + 1), lambda i: (i > F.size("tokens")) | F.get("tokens", i - 1).rlike(f"^(?:{OPERATOR})$"))
    starts = F.concat(F.array(F.lit(0)), cuts)
    spans = F.zip_with(F.slice(starts, 1, F.size(cuts)), cuts, lambda low, cut: F.slice("tokens", low + 1, cut - low - 1))
    between = F.transform(F.split("command", OPERATOR), lambda x: F.array_remove(F.split(x, r"\s+"), ""))
    parts = listed.select("*", F.posexplode(F.when(F.col("simple"), between).otherwise(spans)).alias("segment", "part")).where("size(part) > 0").drop("tokens")
    redirects = lambda x: x.rlike(f"^{REDIRECTION}$")
    target = lambda i: redirects(F.get("part", i - 1)) & (i > 0)
    words = F.filter("part", lambda x, i: ~(redirects(x) | F.coalesce(target(i), F.lit(False))))
    files = F.filter("part", lambda x, i: F.coalesce(target(i) & ~F.get("part", i - 1).endswith("&"), F.lit(False)))
    base = lambda x: F.regexp_extract(unquoted(x), r"[^/]*$", 0)
    led = lambda x: x.isin(LEADING) | x.rlike(r"^[A-Za-z_]\w*=") | x.startswith("-") | base(x).isin(INVOKING)
    parts = parts.withColumns({"words": words, "files": files}).withColumn("at", F.array_position(F.transform("words", lambda x: led(x).cast("int")), 0).cast("int"))
    parts = parts.withColumn("head", F.when(F.col("at") > 0, F.get("words", F.col("at") - 1)))
    kind = F.when(F.col("head").isNull() | F.col("head").isin(RESERVED), "control").when(base(F.col("head")).isin(DYNAMIC) | F.col("head").rlike("^[$`]"), "dynamic").otherwise("command")
    parts = parts.withColumns({"kind": kind, "name": F.coalesce(base(F.col("head")), F.lit(""))})
    nothing = F.array().cast("array<string>")
    if tool is None:
        return parts.withColumns({"own": F.lit(False), "subcommand": F.lit(None).cast("string"), "opened": nothing, "named": nothing, "values": nothing}).drop("words", "files", "at", "head")
    own = (F.col("kind") == "command") & (F.col("name") == tool.name)
    arguments = F.slice("words", F.col("at") + 1, F.greatest(F.size("words"), F.lit(1)))
    parts = parts.withColumns({"own": own, "arguments": F.when(own, F.transform(arguments, unquoted)).otherwise(nothing)})
    takes = lambda i: F.coalesce(F.get("arguments", i - 1).isin(list(tool.valued)) & (i > 0), F.lit(False))
    plain = F.filter("arguments", lambda x, i: ~x.startswith("-") & ~takes(i))
    joined = F.filter(F.transform("arguments", lambda x: F.when(F.substring_index(x, "=", 1).isin(list(tool.valued)) & x.contains("="), F.regexp_replace(x, "^[^=]*=", ""))), lambda x: x.isNotNull())
    parts = parts.withColumn("plain", plain)
    return parts.withColumns({
        "subcommand": F.get("plain", F.lit(0)), "opened": F.when(own, F.transform("files", unquoted)).otherwise(nothing),
        "named": F.filter("plain", lambda x, i: (i > 0) & x.rlike(r"[/\\]|(?i)\.(?:jsonl|json|db)\b")), "values": F.concat(F.filter("arguments", lambda x, i: takes(i)), joined),
    }).drop("words", "files", "at", "head", "arguments", "plain")


def audit_calls(commands: DataFrame, patterns: list[tuple[str, str, bool]], tool: Tool | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Deviations, rows for review and unanalysable calls of a table (id, call_index, command).

    patterns are the caller's, who knows what a run may not reach for: an id, an expression over a command's tokens, and
    whether a match makes the run invalid.

    Deviations (id, call_index, pattern, invalidating, excerpt): patterns outside quoted phrases, and changes by the
    archive's own tool. Of a proper call of that tool only the files count that it opens or names; one that is just
    named invalidates nothing. Review (id, call_index, reason): what can't be decided. An automaton isn't needed: the
    list of patterns is short and part of the plan.
    """
    has = F.coalesce(trimmed(F.col("command")), F.lit("")) != ""
    parts = command_segments(commands.where(has), tool)
    variable = F.coalesce(F.col("subcommand").rlike("[$`]"), F.lit(False))
    changing = F.coalesce(F.col("subcommand").isin(list(tool.changing)) if tool else F.lit(False), F.lit(False))
    proper = F.col("own") & ~variable & ~changing
    target = lambda c, opened: F.transform(c, lambda x: F.struct(masked(x).alias("text"), F.lit(opened).alias("opened")))
    shown = F.array_join(F.when(F.col("simple"), F.col("part")).otherwise(F.transform("part", masked)), " ")
    targets = F.when(proper, F.concat(target(F.col("opened"), True), target(F.col("named"), False))).otherwise(F.array(F.struct(shown.alias("text"), F.lit(True).alias("opened"))))
    judged = parts.withColumns({"variable": variable, "changing": changing, "targets": targets})
    met = lambda rx, bad: F.try_element_at(F.filter("targets", lambda t: t["text"].rlike(rx) & (t["opened"] | F.lit(not bad))), F.lit(1))["text"]
    row = lambda name, bad, excerpt: F.when(excerpt.isNotNull(), F.struct(F.lit(name).alias("pattern"), F.lit(bad).alias("invalidating"), excerpt.alias("excerpt")))
    found = [row(name, bad, F.regexp_extract(met(rx, bad), f"(.{{0,60}}(?:{rx}).{{0,60}})", 1)) for name, rx, bad in patterns]
    found.append(row("change", False, F.when(F.col("changing"), F.substring(shown, 1, 80))))
    deviations = judged.select("id", "call_index", F.explode(F.array_compact(F.array(*found))).alias("x")).select("id", "call_index", "x.*").distinct()
    reasons = F.array_compact(F.array(
        F.when(F.col("kind") == "dynamic", F.lit("dynamic command")), F.when(F.col("own") & F.col("variable"), F.lit("variable subcommand")),
        F.when(proper & F.exists("values", lambda x: x.rlike(r"[/\\]")), F.lit("option with a path")),
    ))
    review = judged.select("id", "call_index", F.explode(reasons).alias("reason")).unionByName(commands.where(F.col("command").rlike(r"\$\(|`")).select("id", "call_index", F.lit("substitution").alias("reason"))).distinct()
    return deviations, review, commands.where(~has).select("id", "call_index")


def audit_summary(deviations: DataFrame, patterns: list[tuple[str, str, bool]]) -> DataFrame:
    """(pattern, calls, questions, invalidating, patterns): patterns is the mark of the list, by which audits can be compared."""
    mark = "\n".join(f"{n}:{rx}:{bad}" for n, rx, bad in patterns)
    return deviations.groupBy("pattern").agg(F.countDistinct("id", "call_index").alias("calls"), F.countDistinct("id").alias("questions"), F.max("invalidating").alias("invalidating")).withColumn("patterns", F.substring(F.sha2(F.lit(mark), 256), 1, 16))


def audit_status(responses: DataFrame, deviations: DataFrame, unanalysable: DataFrame) -> DataFrame:
    """One row: scanned, calls, unreadable, unanalysable, deviating and invalid calls, and complete or incomplete."""
    counts = responses.agg(F.count_if(F.col("id").isNotNull()).alias("scanned"), F.sum(F.when(F.col("id").isNotNull(), F.coalesce(F.size("toolCalls"), F.lit(0))).otherwise(0)).alias("calls"), F.count_if(F.col("id").isNull()).alias("unreadable"))
    bad = deviations.agg(F.countDistinct("id", "call_index").alias("deviating"), F.countDistinct(F.when(F.col("invalidating"), F.struct("id", "call_index"))).alias("invalid"))
    joined = counts.join(F.broadcast(bad)).join(F.broadcast(unanalysable.agg(F.count("*").alias("unanalysable"))))  # single rows
    return joined.withColumn("status", F.when((F.col("unreadable") > 0) | (F.col("unanalysable") > 0), "incomplete").otherwise("complete"))
