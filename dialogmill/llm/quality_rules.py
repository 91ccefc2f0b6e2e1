"""Quality rules with cross-document line frequency, in DataFrame functions only.

Lines are normalised (A-Z lower-cased, white space runs as one space, outer spaces off) and hashed. A line is above
the limit where more than max(min_count, share * documents of the host) distinct documents of the host hold it; with
a ceiling (most), the limit doesn't grow beyond it with the host. Lines above the limit are removed, keep_passing
gives the texts without them; a document that keeps less than depleted of its words is rejected. Base rules reject
texts of fewer than 50 words and texts with more than half of their words in repeated 3-word windows.

A document is an id (count="documents", which op5 and its SQL take); rows without an id are told apart by their text.
With count="texts", which keep_passing takes, exact copies of a text are one document: the pipeline removes copies
later, and counting them here would reject all of a large group of copies, the one to keep included.

Rows: a null or empty text has no words and fails. A null host is a host of its own. Repeated rows count once, and
each is judged by its own text. A line without a word is never counted. Very long texts only make longer arrays
within their row. An empty table gives an empty result. Further columns are not read, or kept by keep_passing.

Scale: counts are aggregated before each shuffle, so a line, text or host of a third of all rows costs a row for each
task. Rows of a line above the limit meet it in a join that is broadcast, or else dealt out by LINE_SALT further keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialogmill.llm.common import table

MIN_COUNT, SHARE, DEPLETED = 5, 0.1, 0.3
#: The greatest limit of keep_passing, however large the host is.
MOST = 30
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Repeated windows of a text up to which they are looked up one by one.
FEW = 16
#: Keys over which the rows of one common line are dealt out.
LINE_SALT = 8


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")


def let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(found: Column) -> Column:
    """Words that lie in 3-word windows found twice or more."""
    n = F.size(found)
    grams = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(found, i), F.get(found, i + 1), F.get(found, i + 2))))

    def covered(starts: Column) -> Column:
        """Words under the windows that begin at these ascending places."""
        return F.aggregate(
            starts,
            F.struct(F.lit(0).alias("sum"), F.lit(-3).alias("last")),
            lambda s, x: F.struct((s["sum"] + F.least(F.lit(3), x - s["last"])).alias("sum"), x.alias("last")),
            lambda s: s["sum"],
        )

    def look_up(g: Column, repeated: Column) -> Column:
        return covered(F.filter(F.transform(g, lambda h, i: F.when(F.array_contains(repeated, h), i)), lambda x: x.isNotNull()))

    def sort_up(g: Column) -> Column:
        placed = F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = let(placed, lambda p: F.filter(F.transform(p, lambda x, i: F.when((F.get(p, i - 1)["h"] == x["h"]) | (F.get(p, i + 1)["h"] == x["h"]), x["i"])), lambda x: x.isNotNull()))
        return covered(F.array_sort(starts))

    def count(g: Column) -> Column:
        repeated = let(F.sort_array(g), lambda s: F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (x == F.get(s, i - 1)))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(let(repeated, lambda r: F.when(F.size(r) <= FEW, look_up(g, r)).otherwise(sort_up(g))))

    return F.when(n < 3, 0).otherwise(let(grams, count)).cast("bigint")


def base_metrics(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    spaces = "\x20\t\n\x0b\x0c\r"
    symbols = "#*$%&|<>"
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, spaces, "")) > 0)
    base = docs.select(*keep, text.alias("text__"), words(text).alias("words__"), lines.alias("lines__"))
    return base.select(
        *keep,
        F.size("words__").cast("bigint").alias("n_words"),
        F.length(F.translate("text__", spaces, "")).cast("bigint").alias("word_chars"),
        (F.length("text__") - F.length(F.translate("text__", symbols, ""))).cast("bigint").alias("n_symbols"),
        (F.size("lines__") - F.size(F.array_distinct("lines__"))).cast("bigint").alias("n_dup_lines"),
        repeat_words(F.col("words__")).alias("n_repeat_words"),
    ).withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))


def _named(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """docs with id__, host__ and digest__, which name a row; text__ is never null."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns({"id__": F.col(id_col), "host__": F.coalesce(F.col(host_col), F.lit("")), "digest__": F.xxhash64(text), "text__": text})


def _same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["id__"].eqNullSafe(b["id__"]) & (a["host__"] == b["host__"]) & (a["digest__"] == b["digest__"])


def _document(count: str) -> Column:
    """What counts as one document of a host."""
    if count == "texts":
        return F.col("digest__")
    return F.struct(F.col("id__"), F.when(F.col("id__").isNull(), F.col("digest__")).alias("own"))


def common_lines(named: DataFrame, min_count: int, share: float, most: int | None, count: str) -> DataFrame:
    """For each row of _named with a line above its host's limit: lines__, the places (at) and words (n) of such lines."""
    base = named.select("id__", "host__", "digest__", "text__")
    limit = F.greatest(F.lit(float(min_count)), F.lit(share) * F.col("documents__"))
    limit = limit if most is None else F.least(limit, F.lit(float(most)))
    limits = base.groupBy("host__").agg(F.countDistinct(_document(count)).alias("documents__")).select("host__", limit.alias("limit__"))
    lines = base.select("id__", "host__", "digest__", F.posexplode(F.split("text__", "\n")).alias("at__", "line__"))
    normal = F.trim(F.regexp_replace(F.translate("line__", UPPER, LOWER), r"[\x20\x09-\x0D]+", " "))
    lines = lines.select("id__", "host__", "digest__", "at__", normal.alias("line__")).where("line__ <> ''").select("id__", "host__", "digest__", "at__", F.xxhash64("line__").alias("hash__"), (F.length("line__") - F.length(F.translate("line__", " ", "")) + 1).alias("n__"))
    # distinct documents of a line: pairs are aggregated before each of the two shuffles
    counted = lines.groupBy("host__", "hash__").agg(F.countDistinct(_document(count)).alias("held__")).where(F.col("held__") > (min_count if most is None else min(min_count, most)))
    above = counted.join(limits, "host__").where("held__ > limit__").select("host__", "hash__", F.explode(F.sequence(F.lit(0), F.lit(LINE_SALT - 1))).alias("salt__"))
    found = F.collect_set(F.struct(F.col("at__").alias("at"), F.col("n__").alias("n")))
    salted = lines.withColumn("salt__", F.pmod(F.xxhash64("id__", "digest__"), F.lit(LINE_SALT)).cast("int"))
    return salted.join(above, ["host__", "hash__", "salt__"]).groupBy("id__", "host__", "digest__").agg(F.array_sort(found).alias("lines__"))


def without_lines(text: Column, at: Column) -> Column:
    """text without its lines at these places; array_except looks them up by hash, so long texts cost no more for each line."""
    return let(F.split(text, "\n"), lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), at), lambda i: F.get(x, i)), "\n"))


def _judged(docs: DataFrame, id_col: str, text_col: str, host_col: str, min_count: int, share: float, depleted: float, most: int | None, count: str) -> DataFrame:
    """id__, host__ and digest__, which name a row, base metrics, base_failed, lines__ (of common_lines), n_common_words, kept."""
    named = _named(docs, id_col, text_col, host_col)
    base, common = base_metrics(named, ["id__", "host__", "digest__"], text_col), common_lines(named, min_count, share, most, count)
    words_in = F.coalesce(F.aggregate("lines__", F.lit(0).cast("bigint"), lambda s, x: s + x["n"]), F.lit(0).cast("bigint"))
    joined = base.join(common, _same_row(base, common), "left").select(base["*"], "lines__", words_in.alias("n_common_words"))
    kept = ~F.col("base_failed") & (F.col("n_words") - F.col("n_common_words") >= F.lit(depleted) * F.col("n_words"))
    return joined.withColumn("kept", kept)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_count: int = MIN_COUNT, share: float = SHARE, depleted: float = DEPLETED, most: int | None = None, count: str = "documents") -> DataFrame:
    """id, base metrics, base_failed, n_common_words, kept for each row."""
    judged = _judged(docs, id_col, text_col, host_col, min_count, share, depleted, most, count)
    return judged.select(F.col("id__").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_common_words")


def keep_passing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_count: int = MIN_COUNT, share: float = SHARE, depleted: float = DEPLETED, most: int | None = MOST, count: str = "texts") -> DataFrame:
    """docs without the rows that the rules reject and without the lines above the limit in the others, with the same columns.

    A row is named by its id, its host and its text: rows with a null id are judged as well, and of rows that share
    an id each goes or stays by its own text.
    """
    judged = _judged(docs, id_col, text_col, host_col, min_count, share, depleted, most, count)
    touched = judged.where("NOT kept OR lines__ IS NOT NULL").select("id__", "host__", "digest__", F.col("kept").alias("kept__"), "lines__").distinct()
    own = _named(docs, id_col, text_col, host_col)
    left = own.join(touched, _same_row(own, touched), "left").where("coalesce(kept__, true)")
    text = F.when(F.col("lines__").isNull(), F.col(text_col)).otherwise(without_lines(F.col("text__"), F.col("lines__.at")))
    return left.select(*(text.alias(c) if c == text_col else own[c] for c in docs.columns))


def op5_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


#: A row has a key of its own (k), so repeated rows are judged each; documents are counted by id, without one by text.
OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, doc_id, host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT k, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
g2 AS (SELECT k, i, concat_ws(' ', words[i], words[i + 1], words[i + 2]) AS gram FROM g),
g3 AS (SELECT k, i, count(*) OVER (PARTITION BY k, gram) AS n FROM g2),
r AS (SELECT k, count(DISTINCT j) AS n_repeat_words FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM g3 WHERE n > 1) GROUP BY k),
o AS (SELECT k, host, text, CASE WHEN doc_id IS NULL THEN 'text ' || text ELSE 'id ' || doc_id END AS document FROM d),
l AS (SELECT k, host, document, trim(regexp_replace(translate(unnest(string_split(text, chr(10))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM o),
t AS (SELECT host, count(DISTINCT document) AS documents FROM o GROUP BY host),
c AS (SELECT host, line, count(DISTINCT document) AS held FROM l WHERE line <> '' GROUP BY host, line),
a AS (SELECT c.host, c.line FROM c JOIN t ON c.host = t.host WHERE c.held > greatest(5, 0.1 * t.documents)),
x AS (SELECT l.k, sum(length(l.line) - length(replace(l.line, ' ', '')) + 1) AS common FROM l JOIN a ON l.host = a.host AND l.line = a.line GROUP BY l.k),
m AS (SELECT w.doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda v: length(v))), 0) AS word_chars,
             length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(common, 0) AS n_common_words
      FROM w LEFT JOIN r ON w.k = r.k LEFT JOIN x ON w.k = x.k),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND n_words - n_common_words >= 0.3 * n_words AS kept, n_common_words::BIGINT AS n_common_words
FROM f
"""
