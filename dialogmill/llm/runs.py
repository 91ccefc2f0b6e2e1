"""Periodic runs of words, by Baier's grouping and the Lyndon roots of runs.

A run is a stretch of consecutive words with a smallest period, long enough (least words, and times periods), that no
neighbouring word extends with that period.

* Phase one of Baier's suffix sorter puts positions into groups, from the highest to the lowest; a group's members
  lengthen the words of the positions before them, which go to new groups. When a group's turn comes, the word of each
  member is the longest Lyndon word that starts there. The phase is done for the order of words and for the reverse
  order; both Lyndon arrays come out of it directly, without sorting suffixes.
* Each run has a root that is the longest Lyndon word at its start, under one of the orders. Roots that are followed
  by an equal one are extended to both sides by the length that the text and the text one period later have in common
  (LCE). Words are compared themselves, by exact numbers of their bytes, never by hashes.
* Before that, stretches in which no long run can lie are left out: of a run of at least four periods and six words,
  each triple of neighbouring words occurs three times within it. Triples that occur less often in their stretch are
  taken out, until nothing changes. That loses no run, and leaves little of ordinary prose to be grouped.

Every text is worked on whole, in its own row, in time proportional to its words; texts are not shuffled.

Rows: a null or empty text, or one of white space only, has no words, no runs and an empty collapsed text. Each row goes by
its own text, so null, shared and repeated ids have the same results as others. Ties between runs of equal length go to
the smaller start, then to the smaller period. An empty table gives an empty result. Further columns are kept by
periodic_runs, except for those named runs, n_words and collapsed, which are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialogmill.llm.bytescan import pieces
from dialogmill.llm.common import table

LEAST, TIMES = 6, 4
WORD = r"[^\x20\x09-\x0D]+"


def lyndon_groups(x: list[int]) -> tuple[list[int], list[int]]:
    """The length of the longest Lyndon word at each position of x, whose signs are 0, 1, 2 and so on; and the number of its group.

    Positions have one group if and only if they have one Lyndon word.

    Groups are a linked list in their order. An open position is linked with the open positions beside it; the next
    one is where its word ends. A group's members close, and the open position before a chain of k of them gets their
    words, so it goes to a new group above its own: one for each k, the larger k above.
    """
    n = len(x)
    group = list(x)
    top = max(x, default=-1)
    members: list[list[int]] = [[] for _ in range(top + 1)]
    for i, sign in enumerate(x):
        members[sign].append(i)
    above, below = list(range(1, top + 2)), list(range(-1, top))
    left, right = list(range(-1, n)), list(range(1, n + 2))
    length = [0] * n
    g = top
    while g >= 0:
        before: list[int] = []
        chain: list[int] = []
        for i in members[g]:
            if group[i] == g:
                p, q = left[i], right[i]
                length[i] = q - i
                left[q] = p
                if p >= 0:
                    right[p] = q
                    if before and before[-1] == p:
                        chain[-1] += 1
                    else:
                        before.append(p)
                        chain.append(1)
        fresh: dict[tuple[int, int], list[int]] = {}
        for p, k in zip(before, chain):
            fresh.setdefault((group[p], k), []).append(p)
        for old, k in sorted(fresh, reverse=True) if len(fresh) > 1 else fresh:
            new, over = len(members), above[old]
            members.append(fresh[old, k])
            above.append(over)
            below.append(old)
            below[over] = new
            above[old] = new
            for p in members[new]:
                group[p] = new
        g = below[g]
    return length, group


def common_length(x: np.ndarray, i: int, j: int) -> int:
    """How many signs from i on equal those from j on; i < j."""
    done, step = 0, 32
    while j + done < len(x):
        size = min(step, len(x) - j - done)
        other = x[i + done : i + done + size] != x[j + done : j + done + size]
        if other.any():
            return done + int(other.argmax())
        done, step = done + size, step * 2
    return done


def runs_of(x: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of x with at least `least` signs and `times` periods (two or more), by start, then period."""
    x = np.unique(x, return_inverse=True)[1]
    back, found = x[::-1], set()
    for signs in (x, x.max(initial=0) - x):
        length, group = (np.array(v, dtype=np.int64) for v in lyndon_groups(signs.tolist()))
        # of a chain of roots the first is enough; a run of three periods has two of them at least
        here = np.arange(len(x))
        after = np.minimum(here + length, len(x) - 1)
        linked = (here + length < len(x)) & (group[after] == group)
        root = linked.copy() if times >= 3 else here + length < len(x)
        root[after[linked]] = False
        for i in np.flatnonzero(root).tolist():
            q = int(length[i])
            low = i - common_length(back, len(x) - i - q, len(x) - i)
            high = i + q + common_length(x, i, i + q)
            if high - low >= max(least, times * q):
                found.add((low, high - low, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(x: np.ndarray, text: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of the parts of x in which runs of six words and four periods can lie; text numbers the text of each word."""
    n = len(x)
    if n < LEAST:
        return []
    wide = lambda a, b: np.unique(a.astype(np.int64) * (int(b.max()) + 1) + b, return_inverse=True)[1]
    triple = wide(wide(x[:-2], x[1:-1]), x[2:])
    live = text[:-2] == text[2:]
    while True:
        at = np.flatnonzero(live)
        if not len(at):
            return []
        first = np.ones(len(at), dtype=bool)
        first[1:] = np.diff(at) > 1
        first[1:] |= text[at[1:]] != text[at[:-1]]
        part = np.cumsum(first) - 1
        # a run's triples start at LEAST - 2 places in a row at least
        size = np.bincount(part)[part]
        key = wide(part, triple[at])
        keep = (np.bincount(key)[key] >= TIMES - 1) & (size >= LEAST - 2)
        if keep.all():
            low = at[first]
            high = at[np.append(np.flatnonzero(first)[1:], len(at)) - 1] + 3
            return list(zip(low.tolist(), high.tolist()))
        live[at[~keep]] = False


def _numbers(words: list[bytes]) -> np.ndarray:
    """Equal words have equal numbers, others don't."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))


def text_runs(texts: list[list[bytes]], least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """Runs of each text, in word numbers of the text."""
    x = _numbers([w for words in texts for w in words])
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    # shorter runs than the filter is for are looked for everywhere
    parts = stretches(x, text) if least >= LEAST and times >= TIMES else [(int(a), int(b)) for a, b in zip(first[:-1], first[1:]) if b > a]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for low, high in parts:
        i = int(text[low])
        out[i] += [(int(start + low - first[i]), int(n), int(q)) for start, n, q in runs_of(x[low:high], least, times)]
    return out


def collapsed_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """words without those that lie in a run after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for start, n, q in runs:
        edge[start + q] += 1
        edge[start + n] -= 1
    return [w for w, inside in zip(words, np.cumsum(edge[:-1]).tolist()) if not inside]


def periodic_runs(docs: DataFrame, text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """docs with n_words, runs (array of start, length, period, by start, then period) and collapsed, the words outside repetitions."""
    kept = docs.drop("n_words", "runs", "collapsed") if text_col not in ("n_words", "runs", "collapsed") else docs
    columns, text_at = kept.columns, kept.columns.index(text_col)
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for batch in batches:
            for low, high, data, at in pieces(batch.column(text_at)):
                raw = data.tobytes()
                # ASCII white space, which is what bytes are split at
                texts = [raw[a:b].split() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                found = text_runs(texts, least, times)
                out = [
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([[dict(start=s, length=n, period=q) for s, n, q in r] for r in found], run_type),
                    pa.array([b" ".join(collapsed_words(t, r)) for t, r in zip(texts, found)], pa.binary()).cast(pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([*batch.slice(low, high - low).columns, *out], names=[*columns, "n_words", "runs", "collapsed"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema]
    return kept.mapInArrow(run, ", ".join([*fields, "n_words bigint", "runs array<struct<start:bigint,length:bigint,period:bigint>>", "collapsed string"]))


def with_planted_period(docs: DataFrame) -> DataFrame:
    """(doc_id, text): each tenth document by crc32 of its id has a periodic end; a null id has none."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", h.alias("h"))
    words = words.withColumn("w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    some = F.size("w") > 0
    g = F.floor(F.col("h") / 10)
    words = words.withColumn("a", F.when(some, g % F.size("w"))).withColumn("p", F.when(some, 1 + F.floor((F.size("w") - F.col("a")) / (3 + g % 8))))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    changed = F.array_join(F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.get("w", place(i).cast("int"))), " ")
    return words.select("doc_id", F.when(some, changed).otherwise(F.col("text")).alias("text"))


def longest(runs: Column) -> Column:
    """The run of greatest length; ties: the smallest start, then the smallest period. Null without runs."""
    order = F.transform(runs, lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period")))
    best = F.array_min(order)
    return F.struct(best["start"].alias("start"), (-best["n"]).alias("length"), best["period"].alias("period"))


def op11_runs(spark, sf_dir):
    found = periodic_runs(with_planted_period(table(spark, sf_dir, "documents").select("doc_id", "text")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    best = longest(F.col("runs"))
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
