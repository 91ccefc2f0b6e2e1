"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in DataFrame functions only.

A text's paragraphs are its lines, cut further after sentence ends, without outer spaces; each distinct one counts
once, as a digest of 48 bits and a 16-bit check. A sketch has three tables of eight cells. A digest goes to one
cell of each table, and a cell is the XOR of its digests; the check and the digest's place tell a cell with a single
digest, so no count is kept. Cells subtract between two texts; peeling cells that hold a single digest then recovers
the digests in which the texts differ, and the digests' owner tells the side. Where peeling stops early, a larger
sketch is taken: the digests of what failed are dealt out by further bits to 8 sketches, then to 64, then to 4,096
(98,304 cells). What is left even then is compared directly.

The fingerprint of a text is its sketch, as text, in the first size of each group at which its own digests peel out.
Digests keep their cells in all sizes, so smaller sketches are XORs of it, and larger ones follow from the digests
that peel out of it: the likeness of two texts is a function of their two fingerprints alone.

Likeness is the share of common digests: |A and B| / |A or B|, and 1 for two texts without any.

Rows: a null text counts as empty and has the empty sketch. Equal texts have equal fingerprints. Ids may be null,
negative, wide or repeated: the order is by id, descending, nulls last, then by the text's hash. Very long texts only
make longer arrays within their row. An empty table gives an empty result. Further columns are kept.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dialogmill.llm.common import table

TABLES, CELLS, TURNS = 3, 8, 6
#: Sketches that a retry deals the digests of one to.
WIDER = (8, 8, 64)
#: Rows of a range on average, in which texts are put next to one another, and the most ranges there are.
RANGE_ROWS, MAX_RANGES = 1024, 8192
#: Rows whose keys are looked at to choose the ranges, for each range. They only set the ranges' sizes.
LOOKED_AT = 16


# The sketches are SQL expressions as text: built once, they nest to any depth without a call for each node. `d` is
# always a level, which keeps the names of nested lambda variables apart.


def let(name: str, value: str, body: str) -> str:
    """body, in which name stands for value, computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def paragraph_digests(text: str) -> str:
    """Distinct digests of the paragraphs of a text column: 48 bits of hash, then a 16-bit check of these."""
    parts = f"transform(split(regexp_replace(coalesce({text}, ''), '([.!?]) +', '$1\\n'), '\\n'), x -> trim(x))"
    hashed = f"transform(filter({parts}, x -> x <> ''), x -> shiftrightunsigned(xxhash64(x), 16))"
    return f"transform(array_distinct({hashed}), x -> shiftleft(x, 16) | (xxhash64(x) & 65535L))"


def place(digest: str, table_no: int) -> str:
    return f"(shiftrightunsigned({digest}, {16 + 3 * table_no}) & {CELLS - 1}L)"


def group(digest: str, d: int) -> str:
    """The group of a retry: further bits from the top for each."""
    return f"(shiftrightunsigned({digest}, {64 - used(d + 1)}) & {WIDER[d] - 1}L)"


def used(d: int) -> int:
    """Bits that the first d retries deal by."""
    return sum(w.bit_length() - 1 for w in WIDER[:d])


def sketch(digests: str) -> str:
    """The cells of all tables, one table after the other: each the XOR of its digests."""
    one = f"transform(sequence(0L, {CELLS - 1}L), j -> aggregate(filter({digests}, x -> %s = j), 0L, (c, x) -> c ^ x))"
    return "concat(" + ", ".join(one % place("x", t) for t in range(TABLES)) + ")"


def subtract(a: str, b: str) -> str:
    """Common digests cancel out; subtracting is its own reverse."""
    return f"zip_with({a}, {b}, (x, y) -> x ^ y)"


def peel(cells: str) -> str:
    """struct(cells left, found): in each turn the digests that stand alone in a cell are taken out of all tables.

    A cell holds one digest if its check is right and this is the digest's place; one that was taken out twice is none.
    """
    here = f"(shiftrightunsigned(x, 16 + 3 * cast(i div {CELLS} AS int)) & {CELLS - 1}L) = i % {CELLS}"
    pure = f"array_distinct(filter(s.cells, (x, i) -> x <> 0L AND (x & 65535L) = (xxhash64(shiftrightunsigned(x, 16)) & 65535L) AND {here}))"
    turn = let("p", pure, f"IF(size(p) = 0, s, named_struct('cells', {subtract('s.cells', sketch('p'))}, 'found', concat(s.found, p)))")
    start = f"named_struct('cells', {cells}, 'found', cast(array() AS array<bigint>))"
    once = let("f", "array_distinct(z.found)", "IF(size(f) = size(z.found), f, filter(f, y -> size(filter(z.found, x -> x = y)) % 2 = 1))")
    return let("z", f"aggregate(sequence(1, {TURNS}), {start}, (s, t) -> {turn})", f"named_struct('cells', z.cells, 'found', {once})")


def published(digests: str, d: int = 0) -> str:
    """The sketch of digests as text, in sizes at which they peel out of it.

    A sketch lists its cells that aren't empty, by table and place. One that doesn't peel, or has more digests than
    cells, is a list of the sketches of its groups in brackets; beyond the last size the digests themselves are listed.
    """
    if d > len(WIDER):
        return f"concat('all ', array_join(transform(array_sort({digests}), x -> hex(x)), ','))"
    shown = f"array_join(filter(transform(k{d}, (x, i) -> IF(x = 0L, NULL, concat(i, '=', hex(x)))), x -> x IS NOT NULL), ',')"
    whole = f"forall({let('q', peel(f'k{d}'), 'q.cells')}, x -> x = 0L)"
    if d == len(WIDER):
        return let(f"k{d}", sketch(digests), f"IF({whole}, {shown}, {published(digests, d + 1)})")
    groups = f"concat('[', array_join(transform(sequence(0L, {WIDER[d] - 1}L), g -> {let(f'n{d}', f'filter({digests}, x -> {group("x", d)} = g)', published(f'n{d}', d + 1))}), ';'), ']')"
    flat = f"IF(size({digests}) > {TABLES * CELLS}, NULL, {let(f'k{d}', sketch(digests), f'IF({whole}, {shown}, NULL)')})"
    return f"coalesce({flat}, {groups})"


def differing(a: str, b: str, d: int = 0, sketches: tuple[str, str] | None = None) -> str:
    """struct(a, b, retries): the digests only in a and only in b, recovered from their sketches."""
    if d > len(WIDER):
        return f"named_struct('a', array_except({a}, {b}), 'b', array_except({b}, {a}), 'retries', {d})"
    # the difference of two sketches is the sketch of both lists together
    difference = subtract(*sketches) if sketches else let(f"u{d}", f"concat({a}, {b})", sketch(f"u{d}"))
    found = f"named_struct('a', array_intersect(r{d}.found, {a}), 'b', array_except(r{d}.found, {a}), 'retries', {d})"
    if d == len(WIDER):
        again = differing(a, b, d + 1)
    else:
        part = f"named_struct('a', filter({a}, x -> {group('x', d)} = g), 'b', filter({b}, x -> {group('x', d)} = g))"
        parts = f"transform(sequence(0L, {WIDER[d] - 1}L), g -> {let(f'w{d}', part, differing(f'w{d}.a', f'w{d}.b', d + 1))})"
        joined = f"named_struct('a', flatten(transform(m{d}, x -> x.a)), 'b', flatten(transform(m{d}, x -> x.b)), 'retries', array_max(transform(m{d}, x -> x.retries)))"
        again = let(f"m{d}", parts, joined)
    whole = f"forall(r{d}.cells, x -> x = 0L)"
    return let(f"r{d}", peel(difference), f"IF({whole}, {found}, {again})")


def likeness(a: str, b: str, difference: str) -> str:
    """Share of common digests of a and b, from the sizes and the recovered difference."""
    return f"IF(size({a}) + size({b}) = 0, 1D, (size({a}) - size({difference}.a)) / cast(size({b}) + size({difference}.a) AS double))"


def _ranges(docs: DataFrame, key: Column) -> list[dict]:
    """Keys of rows of docs at which ranges begin, in descending order; the first is the largest of all."""
    highest, n = docs.agg(F.max(key), F.count("*")).first()
    if not n:
        return []
    ranges = min(MAX_RANGES, max(1, n // RANGE_ROWS))
    looked = docs.sample(min(1.0, LOOKED_AT * ranges / n), seed=1).select(key.alias("k")).distinct().collect() if ranges > 1 else []
    order = lambda k: (k["i"] is not None, k["i"] or 0, k["h"])
    found = sorted((r["k"] for r in looked), key=order, reverse=True)
    starts = [found[i * len(found) // ranges] for i in range(1, ranges)] if found else []
    out = [highest]
    for k in starts:
        if order(k) < order(out[-1]):
            out.append(k)
    return [{"i": k["i"], "h": k["h"]} for k in out]


def with_next(docs: DataFrame, id_col: str, col: str, out: str, also: dict[str, str] | None = None) -> DataFrame:
    """docs with col of the row that follows in descending order of the id (ties: of the hash of col), after the last the first.

    also names further columns of that row, and what they are called here.

    Rows are dealt into ranges of their keys (id and hash) that begin at rows of a small sample, so ranges are even
    whatever the ids are; ids that many rows share are split by their texts. A range's first row is sent to the range
    before as well, where it follows the last. Texts are shuffled once. A range is sorted with spilling, so it needn't
    fit in memory. Only rows equal in id and text are never split.
    """
    key = F.struct(F.col(id_col).alias("i"), F.xxhash64(col).alias("h"))
    starts = _ranges(docs, key)
    wanted = {col: out} | (also or {})
    if not starts:
        return docs.withColumns({b: F.col(a) for a, b in wanted.items()})
    kind = docs.select(key.alias("k")).schema["k"].dataType.simpleString()
    bounds = f"from_json('{json.dumps(starts)}', 'array<{kind}>')"
    keyed = docs.withColumn("key__", key)
    # the last start that isn't below the key, by halving: bounds[at] >= key holds throughout
    steps = max(1, len(starts).bit_length())
    sizes = "array(" + ", ".join(str(2**i) for i in reversed(range(steps))) + ")"
    at = f"aggregate({sizes}, 0, (at, s) -> IF(at + s < {len(starts)} AND get({bounds}, at + s) >= key__, at + s, at))"
    placed = keyed.withColumn("range__", F.expr(at))
    first = F.expr(f"get({bounds}, range__) = key__")
    before = (F.col("range__") + len(starts) - 1) % len(starts)
    own = F.struct(F.col("range__").alias("range"), F.lit(True).alias("own"))
    copied = F.struct(before.cast("int").alias("range"), F.lit(False).alias("own"))
    spread = placed.withColumn("to__", F.explode(F.when(first, F.array(own, copied)).otherwise(F.array(own))))
    spread = spread.select(*docs.columns, "key__", F.col("to__.range").alias("range__"), F.col("to__.own").alias("own__"))
    order = W.partitionBy("range__").orderBy(F.col("own__").desc(), F.col("key__").desc(), F.col(col))
    return spread.withColumns({b: F.lead(a).over(order) for a, b in wanted.items()}).where("own__").select(*docs.columns, *wanted.values())


def edited(text: Column, following: Column) -> Column:
    """text with its last half replaced by as many characters of the following one, or all that it has."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def op1_fingerprints(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # a text's digests and cells go with it to the row before, which compares itself with them
    own = docs.withColumn("p", F.expr(paragraph_digests("text"))).withColumn("cp", F.expr(sketch("p")))
    both = with_next(own, "doc_id", "text", "following", {"p": "r", "cp": "cr"}).withColumn("edited", edited(F.col("text"), F.col("following")))
    digests = both.select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        "p", "cp", "r", "cr", F.expr(paragraph_digests("edited")).alias("q"),
    )
    cells = digests.withColumn("cq", F.expr(sketch("q")))
    found = cells.withColumns({f"d{x}": F.expr(differing("p", x, 0, ("cp", f"c{x}"))) for x in "qr"})
    return found.selectExpr(
        "doc_id", "n_chars", "edited_sha256", f"{published('p')} AS fingerprint", f"{published('q')} AS edited_fingerprint",
        f"{likeness('p', 'q', 'dq')} AS near_edited", f"{likeness('p', 'r', 'dr')} AS near_next", "dq.retries AS retries_edited", "dr.retries AS retries_next",
    )
