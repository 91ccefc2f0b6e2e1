"""MinHash near-duplicate detection with odd sketches.

Each document's distinct 4-word shingles give 512 MinHash samples. The samples are folded into a parity bitmap of
1,024 bits (odd sketch); the population count of the XOR of two bitmaps estimates high similarities precisely, with
a standard error of 0.02 at 0.8, and screens the candidates of 32 bands of four samples at 0.8 - slack. Every link is then confirmed
on the full shingle sets. A shingle is named by 64 mixed bits of its words' BLAKE2 hashes, so no two of different words
are taken for one but by a chance of 2**-64.

* Documents with equal sets form one class; only a class's smallest id goes on, so copies are never paired.
* Round by round, each representative is compared with one band leader of another component, the one with which
  it shares most bands; confirmed links are merged into components.
* What is still apart in some band after that is compared across components, behind the sketch. Where few members of
  a band are outside its largest component, these meet all members, in blocks. A band with more of them (texts of a
  common template, too unlike for a link) would make pairs by the square; its documents are compared by rare shingles
  instead: two sets of a similarity of 0.8 share one of the rarest 20 % of each, so shingles that only one of these
  documents has, as the own parts of templated texts are, make no pair. That is exact for any number of documents.
* A pair at exactly 0.8 is in no common band with a chance of (1 - 0.8**4)**32, about 5e-8, and fails the screen,
  4.2 standard errors below, with one of about 1e-5; above 0.8 both fall off steeply. exact=True compares all
  representatives by rare shingles without the screen, and misses no link.

Rows: a null or empty text, or one of spaces only, has no shingles and is linked with nothing. Where ids are null or
shared, each row goes by its own text: rows are numbered by id, nulls last, and a component has the id of its first
row. A row with null id takes the component of the rows that it is linked with, else null. keep_one keeps one row of
each group, also of repeated rows. near_duplicates itself wants unique ids that are not null. An empty table gives an
empty result. Further columns of the input are not read, or kept by keep_one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogmill.llm.bytescan import mix, pieces
from dialogmill.llm.common import row_keyed, written

SAMPLES, BANDS, BAND_ROWS, SKETCH_BITS = 512, 32, 4, 1024
#: Members of a band outside its largest component up to which they are compared with all of its members.
OUTSIDE = 64
#: Members of a band or documents of a shingle that meet in one task.
BLOCK_ROWS = 1000
#: Sets of a shingle up to which it counts as rare at first; only speed depends on it.
FEW = 256
#: Edges of a task that contracts them first; only speed depends on it.
EDGES = 1 << 17
#: Shingles of a task that gathers their sets; only speed depends on it.
SHINGLES = 1 << 20
#: Keys over which the members of one class are dealt out.
SALT = 8
_RNG = np.random.default_rng(7)
_XOR = _RNG.integers(0, 2**63, SAMPLES, dtype=np.uint64)
_MUL = _RNG.integers(0, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RNG.integers(1, 2**62, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = _RNG.integers(1, 2**62, SAMPLES, dtype=np.uint64)
_NO_WORD = np.uint64(0x6A09E667F3BCC909)


class Names(dict):
    """64 bits of BLAKE2 of a word's bytes; words that a task has met are remembered, as long as they are few and short."""

    room = 1 << 25

    def __missing__(self, word: bytes) -> int:
        name = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        self.room -= len(word) + 64
        if self.room < 0:
            self.clear()
            self.room = Names.room
        self[word] = name
        return name


_NAMES = Names()


def word_names(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the words of the rows with A-Z in lower case, and for each row the index of its first word (and the end)."""
    raw = data.tobytes().lower()
    # bytes are split at ASCII white space, and only A-Z changes its case
    texts = [raw[a:b].split() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return np.fromiter((_NAMES[w] for t in texts for w in t), dtype=np.uint64, count=int(first[-1])), first


def shingle_sets(data: np.ndarray, at: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row; fewer words than size make one shingle."""
    words, first = word_names(data, at)
    padded = np.concatenate([words, np.full(size, _NO_WORD)])
    rolled = np.zeros(len(words), dtype=np.uint64)
    for i in range(size):
        rolled += padded[i : i + len(words)] * _PLACE[i]
    rolled = mix(rolled)
    out = []
    for low, high in zip(first[:-1], first[1:]):
        if high - low >= size:
            out.append(np.unique(rolled[low : high - size + 1]))
        elif high > low:
            short = np.concatenate([words[low:high], np.full(size - (high - low), _NO_WORD)])
            out.append(mix((short * _PLACE[:size]).sum(dtype=np.uint64, keepdims=True)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def samples(hashes: np.ndarray) -> np.ndarray:
    best = np.full(SAMPLES, np.uint64(2**64 - 1))
    for low in range(0, len(hashes), 128):
        part = hashes[None, low : low + 128] ^ _XOR[:, None]
        part *= _MUL[:, None]
        np.minimum(best, part.min(axis=1), out=best)
    return best


def odd_sketch(sample: np.ndarray) -> np.ndarray:
    """Parity bitmap of the (index, value) pairs as signed 64-bit words."""
    places = mix(sample + _SALT) % np.uint64(SKETCH_BITS)
    bits = np.bincount(places.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def band_keys(sample: np.ndarray) -> np.ndarray:
    keys = (sample[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS) * _PLACE[:BAND_ROWS]).sum(axis=1, dtype=np.uint64)
    return mix(keys + _SALT[:BANDS]).view(np.int64)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """id, n_shingles, set_a and set_b (128 bits that stand for the set), keys (band keys), sketch."""

    def run(batches):
        for batch in batches:
            for low, high, data, at in pieces(batch.column(1)):
                sets = shingle_sets(data, at, size)
                some = [samples(x) if len(x) else None for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, high - low),
                        pa.array([len(x) for x in sets], pa.int64()),
                        pa.array([int(x.sum(dtype=np.uint64).view(np.int64)) for x in sets], pa.int64()),
                        pa.array([int(mix(x + _NO_WORD).sum(dtype=np.uint64).view(np.int64)) for x in sets], pa.int64()),
                        pa.array([[] if x is None else band_keys(x) for x in some], pa.list_(pa.int64())),
                        pa.array([[] if x is None else odd_sketch(x) for x in some], pa.list_(pa.int64())),
                    ],
                    names=["id", "n_shingles", "set_a", "set_b", "keys", "sketch"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, n_shingles bigint, set_a bigint, set_b bigint, keys array<bigint>, sketch array<bigint>"
    )


def full_sets(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for low, high, data, at in pieces(batch.column(1)):
                sets = [x.view(np.int64) for x in shingle_sets(data, at, size)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(sets, pa.list_(pa.int64()))], names=["id", "hashes"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, hashes array<bigint>")


def likeness(a: str, b: str):
    """Estimated similarity of two odd sketches."""
    differing = " + ".join(f"bit_count({a}[{i}] ^ {b}[{i}])" for i in range(SKETCH_BITS // 64))
    return F.expr(f"1 + {SKETCH_BITS} / (4.0 * {SAMPLES}) * ln(greatest(1 - 2.0 * ({differing}) / {SKETCH_BITS}, 1e-9))")


def contracted(edges: DataFrame) -> DataFrame:
    """edges (a, b) with those of each Arrow batch replaced by stars: each id and the smallest one it reaches there."""

    def run(batches):
        for batch in batches:
            ids, ends = np.unique(np.concatenate([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)]), return_inverse=True)
            parent = list(range(len(ids)))

            def root(x):
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            half = len(ends) // 2
            for x, y in zip(ends[:half].tolist(), ends[half:].tolist()):
                x, y = root(x), root(y)
                parent[max(x, y)] = min(x, y)
            roots = np.array([root(x) for x in range(len(ids))], dtype=np.int64)
            moved = np.flatnonzero(roots != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[roots[moved]])], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(run, f"a {edges.schema['a'].dataType.simpleString()}, b {edges.schema['a'].dataType.simpleString()}")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of all ids in edges (a, b): the smallest id reachable, by alternating star contraction.

    Batches of edges are contracted in their tasks first, so chains are short. Minima are aggregated before the
    shuffle. They are joined back by vertex and a salt of the neighbour, so the neighbours of a hub are dealt out over
    SALT keys.
    """
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))

    def stars(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        dealt = both.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALT)).cast("int"))
        pairs = dealt.join(low.withColumn("salt", salts), ["u", "salt"])
        if large:
            moved = pairs.where("v > u").select(F.col("v").alias("a"), F.col("low").alias("b"))
        else:
            moved = pairs.select(F.col("v").alias("a"), F.col("low").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("low").alias("b")))
        return moved.where("a <> b").distinct()

    def finished(e: DataFrame) -> bool:
        """Each id has one smaller one, which has none itself."""
        ends = e.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up > 0 AND down > 0)").isEmpty()

    # few edges lie in few tasks, else no batch has two that meet
    packed = edges.coalesce(1 + edges.count() // EDGES)
    edges = written(contracted(packed).distinct(), "components")
    while not finished(edges):
        edges = written(contracted(stars(stars(edges, True), False)).distinct(), "components")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def gathered(sets: DataFrame) -> DataFrame:
    """(shingle, ids) of sets (id, hashes): a row for each distinct shingle of an Arrow batch, however many of its sets have it.

    Few sets lie in few tasks, else each of many tasks would give on the words of a template once more.
    """
    kind = sets.schema["id"].dataType.simpleString()
    packed = sets.coalesce(1 + (sets.agg(F.sum(F.size("hashes"))).first()[0] or 0) // SHINGLES)

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            hashes = lists.flatten().to_numpy(zero_copy_only=False)
            order = np.argsort(hashes, kind="stable")
            of = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))[order]
            shingles, first = np.unique(hashes[order], return_index=True)
            ends = pa.array(np.append(first, len(hashes)), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(shingles, pa.int64()), pa.ListArray.from_arrays(ends, batch.column(0).take(pa.array(of)))], names=["shingle", "ids"])

    return packed.select("id", "hashes").mapInArrow(run, f"shingle bigint, ids array<{kind}>")


def shared_rare(sets: DataFrame, percent: int) -> DataFrame:
    """(id, rare): 31 bits of each of the first shingles of a set that another set has too, in order; sets: (id, hashes).

    Sets of a similarity of at least percent share one of the first n - ceil(n * percent / 100) + 1 of n shingles in any
    order that holds for all sets. Here a set's own shingles come first, which are only counted; then those of up to FEW
    sets, the rarest first; then all others, as the words of a template are, by their hash. Only shingles of few sets
    meet their sets; a set that has too few of them takes the others from itself, by what it has besides.
    """
    lists = written(gathered(sets), "near-lists")
    held = lists.groupBy("shingle").agg(F.sum(F.size("ids")).alias("held"), F.min(F.get("ids", F.lit(0))).alias("only"))
    held = written(held.where(F.col("held") <= FEW), "near-held")
    alone = held.where("held = 1").select(F.col("only").alias("id"), "shingle")
    own = alone.groupBy("id").agg(F.count("*").alias("own"))
    room = F.expr(f"n - cast(ceil(n * {percent} / 100) AS int) + 1 - coalesce(own, 0)").cast("int")
    able = written(sets.select("id", F.size("hashes").alias("n")).join(own, "id", "left").select("id", room.alias("room")).where("room > 0"), "near-able")
    # sets whose own shingles fill their room share none of the first ones with any other
    rows = lists.join(held.where("held > 1").select("shingle", "held"), "shingle").select(F.explode("ids").alias("id"), "shingle", "held")
    few = rows.join(able.select("id"), "id", "left_semi").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("held", "shingle"))), lambda x: x["shingle"]).alias("few"))
    none = F.array().cast("array<bigint>")
    placed = written(able.join(few, "id", "left").select("id", "room", F.coalesce("few", none).alias("few")), "near-room")
    short = placed.where("size(few) < room")
    mine = alone.join(short.select("id"), "id", "left_semi").groupBy("id").agg(F.collect_list("shingle").alias("mine"))
    wide = sets.join(short, "id").join(mine, "id", "left")
    others = F.array_sort(F.array_except("hashes", F.concat("few", F.coalesce("mine", none))))
    wide = wide.select("id", "room", F.concat("few", others).alias("first"))
    rare = placed.where("size(few) >= room").select("id", "room", F.col("few").alias("first")).unionByName(wide).select("id", F.slice("first", F.lit(1), F.col("room")).alias("x"))
    return rare.select("id", F.expr("array_distinct(transform(x, y -> cast(y & 2147483647 AS int)))").alias("rare")).where("size(rare) > 0")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 80, star_rounds: int = 3, slack: float = 0.085, exact: bool = False) -> DataFrame:
    """id, n_shingles, component_id for each row; linked when 100 * |A and B| >= percent * |A or B|."""
    feats = written(features(docs, id_col, text_col, size), "near-features")
    some = feats.where("n_shingles > 0")
    classes = written(some.groupBy("set_a", "set_b", "n_shingles").agg(F.min("id").alias("rep"), F.count("*").alias("members")).where("rep IS NOT NULL"), "near-classes")
    reps = written(some.join(classes.select("rep").distinct(), F.col("id") == F.col("rep"), "left_semi").dropDuplicates(["id"]).select("id", "n_shingles", "keys", "sketch"), "near-reps")
    short = F.expr("array_distinct(transform(keys, x -> cast(x & 2147483647 AS int)))")
    banded = reps.select("id", F.explode("keys").alias("key"))
    # keys of one representative can never link anything
    shared = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    banded = written(banded.join(shared, "key", "left_semi"), "near-bands")
    narrow = reps.select("id", "n_shingles", "sketch")
    close = F.lit(True) if exact else likeness("sketch_a", "sketch_b") >= percent / 100 - slack
    sizes = F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")

    def named(side: str) -> DataFrame:
        return narrow.select(F.col("id").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}"))

    def screened(pairs: DataFrame) -> DataFrame:
        return pairs.join(named("b"), "b").join(named("a"), "a").where(sizes).where(close).select("a", "b", "n_a", "n_b")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Links among the candidate pairs, on full sets; only the texts of candidates are hashed again."""
        ids = pairs.select(F.col("a").alias(id_col)).unionByName(pairs.select(F.col("b").alias(id_col))).distinct()
        sets = written(full_sets(docs.select(id_col, text_col).join(ids, id_col, "left_semi"), id_col, text_col, size).dropDuplicates(["id"]), "near-sets")
        joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("set_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("set_b")), "b")
        both = F.size(F.array_intersect("set_a", "set_b"))
        return joined.where(100 * both >= percent * (F.col("n_a") + F.col("n_b") - both)).select("a", "b")

    links, labels = None, None

    def labelled(rows: DataFrame) -> DataFrame:
        if labels is None:
            return rows.withColumn("component", F.col("id"))
        return rows.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))

    def across(rows: DataFrame, key: str, listed: str) -> DataFrame:
        """Pairs of rows (key, id, component, blocks, listed) of different components with a key in common, behind sizes and sketch.

        main rows are compared with those of all other components, which are few; the others with each other. A pair
        comes from the first key only that its lists have in common.
        """
        block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
        cells = F.sequence(F.lit(0), F.col("blocks") - 1)

        def side(s: str) -> DataFrame:
            mine, other = ("i", "j") if s == "a" else ("j", "i")
            kept = rows if s == "a" else rows.where("NOT main")
            spread = kept.select(F.col(key).alias("key"), F.col(listed).alias("list"), "id", "component", "main", block.alias(mine), F.explode(cells).alias(other)).join(narrow, "id")
            return spread.select("key", "i", "j", F.col("list").alias(f"list_{s}"), F.col("id").alias(s), F.col("component").alias(f"c_{s}"), F.col("main").alias(f"main_{s}"), F.col("n_shingles").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}"))

        apart = F.expr("c_a <> c_b AND (main_a OR c_a < c_b)")
        a, b = side("a"), side("b")
        first = F.element_at(F.array_intersect("list_a", "list_b"), 1) == a["key"]
        met = (a["key"] == b["key"]) & (a["i"] == b["i"]) & (a["j"] == b["j"])
        return a.join(b, met & apart & sizes & close & first).select("a", "b", "n_a", "n_b")

    for turn in range(0 if exact else star_rounds):
        placed = labelled(banded)
        # a band key's leaders: one member of its first and one of its last component, others each round
        who = F.struct("component", F.xxhash64("id", F.lit(turn)).alias("draw"), "id")
        ends = placed.groupBy("key").agg(F.min(who).alias("low"), F.max(who).alias("high")).where("low.component <> high.component")
        met = placed.join(ends, "key").select(F.col("id").alias("b"), F.explode(F.array("low", "high") if turn else F.array("low")).alias("other"), "component").where("other.component <> component")
        votes = met.groupBy("b", F.col("other.id").alias("a")).agg(F.count("*").alias("votes"))
        pairs = votes.groupBy("b").agg(F.max_by("a", F.struct("votes", -F.col("a"))).alias("a"))
        pairs = written(screened(pairs.select("a", "b")), "near-stars")
        found = written(confirmed(pairs), "near-links")
        if found.isEmpty():
            break
        links = found if links is None else links.unionByName(found)
        labels = components(links)
    blocks = lambda n: (1 + F.floor(F.col(n) / BLOCK_ROWS)).cast("int").alias("blocks")
    if exact:
        rest, many = None, reps.select("id")
    else:
        # of each band in which components meet: the members, and its largest component (main)
        parts = labelled(banded).groupBy("key", "component").agg(F.count("*").alias("n"))
        mixed = parts.groupBy("key").agg(F.sum("n").alias("n"), F.max("n").alias("largest"), F.max_by("component", F.struct("n", "component")).alias("top"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
        apart = written(labelled(banded).join(mixed, "key").select("key", "id", "component", (F.col("component") == F.col("top")).alias("main"), blocks("n"), (F.col("n") - F.col("largest") > OUTSIDE).alias("many")), "near-apart")
        few = apart.where("NOT many").join(reps.select("id", short.alias("list")), "id").withColumn("key", F.expr("cast(key & 2147483647 AS int)"))
        rest, many = across(few, "key", "list"), apart.where("many").select("id").distinct()
    many = written(many, "near-many")
    if not many.isEmpty():
        sets = written(full_sets(docs.select(id_col, text_col).join(many.withColumnRenamed("id", id_col), id_col, "left_semi"), id_col, text_col, size).dropDuplicates(["id"]), "near-many-sets")
        rare = written(shared_rare(sets, percent), "near-rare")
        each = labelled(rare.select("id", "rare", F.explode("rare").alias("shingle")))
        # only shingles in which components meet count; their largest component (main) isn't compared with itself
        sharing = each.groupBy("shingle", "component").agg(F.count("*").alias("n")).groupBy("shingle").agg(F.sum("n").alias("n"), F.max_by("component", F.struct("n", "component")).alias("top"), F.count("*").alias("parts"))
        each = each.join(sharing.where("parts > 1").select("shingle", "top", blocks("n")), "shingle").withColumn("main", F.col("component") == F.col("top"))
        pairs = across(each, "shingle", "rare")
        rest = pairs if rest is None else rest.unionByName(pairs)
    if rest is not None:
        found = written(confirmed(written(rest.distinct(), "near-rest")), "near-links")
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            labels = components(links)
    # each row takes the component of its class; a class of many copies is dealt out by further keys
    named_classes = labelled(classes.withColumnRenamed("rep", "id")).where("members > 1 OR component <> id")
    named_classes = named_classes.select("set_a", "set_b", "n_shingles", "component", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    member = feats.select("id", "n_shingles", "set_a", "set_b", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int").alias("salt"))
    return member.join(named_classes, ["set_a", "set_b", "n_shingles", "salt"], "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without all but the first row of each group of near-duplicates, by id with nulls last, with the same columns.

    Each row goes or stays by its own text, also where the id is null or shared; of repeated rows one stays.
    """
    keyed, key = row_keyed(docs, id_col, text_col)
    found = near_duplicates(keyed, key, text_col, **options)
    drop = found.where(F.col("component_id") < F.col("id")).select(F.col("id").alias(key))
    return keyed.join(drop, key, "left_anti").select(*docs.columns)


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, n_shingles, component_id (the id of the group's first row) and kept for each row."""
    keyed, key = row_keyed(docs.select(id_col, text_col), id_col, text_col)
    found = near_duplicates(keyed, key, text_col, **options)
    if key == id_col:
        return found.select(F.col("id").alias(id_col), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
    names = keyed.select(F.col(key).alias("id"), F.col(id_col).alias("own__"))
    first = names.select(F.col("id").alias("component_id"), F.col("own__").alias("first__"))
    placed = found.join(names, "id").join(first, "component_id")
    kept = F.coalesce(F.col("own__") == F.col("first__"), F.col("id") == F.col("component_id"))
    return placed.select(F.col("own__").alias(id_col), "n_shingles", F.col("first__").alias("component_id"), kept.alias("kept"))


def op8_near_dedup(spark, sf_dir):
    from dialogmill.llm.common import table

    return grouped(table(spark, sf_dir, "documents").select("doc_id", "text"))
