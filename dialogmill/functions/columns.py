"""Column expressions of the archive's records: projections and filters that many jobs share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The fields of a tool's input, in the order in which the first non-empty one stands for the call.
INPUT_FIELDS = ["query", "pattern", "url", "file", "path", "filePath", "description", "prompt", "note", "name"]
# Letters with one diacritic and the letters that stand for them in the index.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzz"

DAY_MS = 86_400_000


def trimmed(text: Column) -> Column:
    """text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def source_of(c: str = "source") -> Column:
    """A missing source is the relational one."""
    return F.coalesce(F.col(c), F.lit("opencode"))


def repo_of(directory: Column, home: str | None = None) -> Column:
    """Last part of a directory; null for none, the root and the home directory of the source's machine, if that is given."""
    path = F.regexp_replace(directory, "/+$", "")
    inner = path != "" if home is None else (path != "") & (path != home)
    return F.when(inner, F.element_at(F.split(path, "/"), -1))


def variant_text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def variant_string(v: Column, path: str) -> Column:
    """The value at path only where it is a JSON string."""
    inner = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(inner) == "STRING", F.try_variant_get(v, path, "string"))


def model_of(v: Column) -> Column:
    """The nested model, else the flat provider and model, else nulls."""
    nested = F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.model", "variant")).startswith("OBJECT"), F.lit(False))
    provider = F.when(nested, variant_text(v, "$.model.providerID")).otherwise(F.coalesce(variant_text(v, "$.providerID"), variant_text(v, "$.provider")))
    model = F.when(nested, variant_text(v, "$.model.modelID")).otherwise(F.coalesce(variant_text(v, "$.modelID"), variant_text(v, "$.model")))
    return F.struct(provider.alias("providerID"), model.alias("modelID"))


def tokens_of(v: Column, root: str) -> Column:
    """Usage at root as five counts, 0 where one is missing; flat cache fields come before nested ones."""

    def n(*paths: str) -> Column:
        return F.coalesce(*(F.try_variant_get(v, f"{root}.{p}", "bigint") for p in paths), F.lit(0).cast("bigint"))

    return F.struct(n("input").alias("in"), n("output").alias("out"), n("reasoning").alias("reasoning"), n("cacheRead", "cache.read").alias("cacheRead"), n("cacheWrite", "cache.write").alias("cacheWrite"))


def cmd_of(v: Column, root: str) -> Column:
    """The most telling text of a tool's input: a string, its command, the first field that says something, or its JSON."""
    whole = F.try_variant_get(v, root, "variant")
    kind = F.schema_of_variant(whole)
    fields = [F.when(variant_string(v, f"{root}.{k}") != "", F.concat(F.lit(f"{k}: "), variant_string(v, f"{root}.{k}"))) for k in INPUT_FIELDS]
    command = F.when(variant_string(v, f"{root}.command") != "", variant_string(v, f"{root}.command"))
    text = F.to_json(whole)
    cut = F.when(F.length(text) > 200, F.concat(F.substring(text, 1, 197), F.lit("..."))).otherwise(text)
    return F.when(kind == "STRING", F.substring(variant_text(v, root), 1, 200)).when(kind.startswith("OBJECT"), F.coalesce(command, *fields, cut)).when(kind == "VOID", F.lit(None)).when(whole.isNotNull(), F.when(kind.startswith("ARRAY"), cut).otherwise(F.substring(variant_text(v, root), 1, 200)))


def exit_code_of(v: Column) -> Column:
    """The first of five places that holds a number or an integer as text."""
    places = ["$.state.metadata.exitCode", "$.state.metadata.exit", "$.state.exitCode", "$.state.exit", "$.exitCode"]
    return F.coalesce(*(F.when(variant_text(v, p).rlike(r"^-?\d+$"), variant_text(v, p).try_cast("int")) for p in places))


def raw_content_of(v: Column) -> Column:
    return F.coalesce(F.nullif(variant_string(v, "$.state.output"), F.lit("")), F.nullif(variant_string(v, "$.state.raw"), F.lit("")))


def unsafe_id(c: Column) -> Column:
    """Ids that are no plain names: separators, control characters, dot-dot, blanks at the ends, or empty."""
    return c.isNull() | (c == "") | c.rlike(r"[/\\:\x00-\x1f\x7f]") | c.contains("..") | (trimmed(c) != c)


def fidelity(source: Column) -> Column:
    """What rows of the line-based source cannot say."""
    return F.when(source == "pi", F.array(F.lit("branches are flattened by time"), F.lit("agents are unknown")))


def format_ts(ts: Column) -> Column:
    """yyyy-MM-dd HH:mm in UTC, whatever the session's zone; ? for null."""
    day, minute = F.floor(ts / DAY_MS).cast("int"), F.floor(F.pmod(ts, F.lit(DAY_MS)) / 60_000).cast("int")
    return F.coalesce(F.concat(F.date_from_unix_date(day).cast("string"), F.format_string(" %02d:%02d", F.floor(minute / 60), minute % 60)), F.lit("?"))


def iso_millis(text: Column) -> Column:
    """Epoch milliseconds of an ISO time; one without a zone, and a date, is in UTC, whatever the session's zone. Null if it is none."""
    whole = F.regexp_replace(text, r"([ T]\d{1,2}:\d{2})(?=$|[A-Za-z+-])", "$1:00")
    whole = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(text, F.lit("T00:00:00Z"))).when(whole.rlike(r"[ T]\d{1,2}:\d{2}:\d{2}(\.\d+)?$"), F.concat(whole, F.lit("Z"))).otherwise(whole)
    # a zone is named: letters, or hours and minutes
    return F.when(whole.rlike(r"([A-Za-z]|[+-]\d{1,2}(:?\d{2})?)$"), F.unix_millis(whole.try_cast("timestamp")))


def truncated(text: Column, chars: int | None = None, full: bool = False, default_chars: int = 400, lines: int = 4) -> Column:
    """struct(shown, shown_len, total, cut): the whole text, its first chars, or the default cut in characters, then lines."""
    text = F.coalesce(text, F.lit(""))
    if full:
        shown = text
    elif chars is not None:
        shown = F.substring(text, 1, chars)
    else:
        shown = F.array_join(F.slice(F.split(F.substring(text, 1, default_chars), "\n"), 1, lines), "\n")
    return F.struct(shown.alias("shown"), F.length(shown).alias("shown_len"), F.length(text).alias("total"), (F.length(shown) < F.length(text)).alias("cut"))


def search_cmd(calls: Column) -> Column:
    return F.array_join(F.filter(F.transform(calls, lambda c: c["cmd"]), lambda x: x != ""), "\n")


def model_name(model: Column) -> Column:
    """provider/model, or null unless both are known."""
    return F.concat(model["providerID"], F.lit("/"), model["modelID"])


def date_bound(text: Column, end: bool) -> Column:
    """Epoch milliseconds of a year, month, day or ISO time in UTC; end is the last millisecond of the period. Months roll over."""
    year = F.regexp_extract(text, r"^(\d{4})", 1).try_cast("int")
    month = F.coalesce(F.regexp_extract(text, r"^\d{4}-(\d{2})", 1).try_cast("int"), F.lit(1))
    day = F.coalesce(F.regexp_extract(text, r"^\d{4}-\d{2}-(\d{2})$", 1).try_cast("int"), F.lit(1))
    base = F.add_months(F.make_date(year, F.lit(1), F.lit(1)), month - 1)
    start = F.date_add(base, day - 1)
    after = F.when(text.rlike(r"^\d{4}$"), F.add_months(start, 12)).when(text.rlike(r"^\d{4}-\d{2}$"), F.add_months(start, 1)).otherwise(F.date_add(start, 1))
    millis = lambda d: F.unix_date(d).cast("bigint") * DAY_MS
    period = millis(after) - 1 if end else millis(start)
    return F.when(text.rlike(r"^\d{4}(-\d{2}(-\d{2})?)?$"), period).otherwise(iso_millis(text))


def anchor_millis(text: Column) -> Column:
    """Epoch milliseconds of 13 digits, or of a real calendar time YYYY-MM-DD[ T]HH:MM[:SS]; a date is its last millisecond. Null if invalid."""
    minute = text.rlike(r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2})?$")
    return F.when(text.rlike(r"^\d{13}$"), text.try_cast("bigint")).when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), iso_millis(text) + DAY_MS - 1).when(minute, iso_millis(text))


def filters(repo=None, session=None, after=None, before=None, model=None, role=None, agent=None, source=None) -> Column:
    """The condition of a search: exact repo, role and agent, a literal session prefix, inclusive times, a model pattern, a source."""
    found = F.lit(True)
    if repo is not None:
        found &= F.col("repo") == repo
    if session is not None:
        found &= F.lower("session_id").startswith(session.lower())
    if after is not None:
        found &= F.col("ts") >= after
    if before is not None:
        found &= F.col("ts") <= before
    if model is not None:
        found &= F.col("model").ilike(f"%{model}%")
    if role is not None:
        found &= F.col("role") == role
    if agent is not None:
        found &= F.col("agent") == agent
    if source not in (None, "all"):
        found &= source_of() == source
    return found
