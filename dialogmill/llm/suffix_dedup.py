"""Removal of byte strings that occur earlier in the corpus, by a sparse, blockwise suffix sort.

Two suffixes matter to each other only if they agree in their first 100 bytes. So the suffix array is built over
that depth, one suffix bucket at a time, and long ties are resolved by ranks of a cover sample that are computed
first:

* The cover sample is chosen by content: of each 100-byte window the 32-byte block with the least hash. Equal
  windows choose the same block at the same offset, which is what a difference cover gives for positions (a common
  offset at which both suffixes are sampled), with 3 % of the positions where a cover of period 73 needs 12 %.
* Neighbouring windows with the same sampled block are one segment; the hash of its bytes is the name of the
  sample. Windows in equal segments tie over their whole depth, and are settled by name alone: 64 bits of hash, within
  one block of equal hash. A segment has at most 168 bytes, too few for words built to have one hash modulo 2**64.
* A suffix bucket is a sampled block. Buckets are dealt out by hash and sorted, one at a time, in a stream: only the
  first segments of a bucket are held, at most HOT_BUCKET of them. Copies within a map task are settled there, so a
  very frequent bucket sends one row from each task for each segment.
* In buckets that hold several segments, the segments' bytes are sent once and sorted: by what follows the start of
  the sampled block and by what precedes it. The two ranks of a sample and the lengths that neighbours in these
  orders have in common settle each of its windows, byte by byte, without comparing the windows themselves.
* Buckets of more than HOT_BUCKET segments over all tasks are dealt out by window, by names alone; blocks with
  more than HOT_BLOCK segments in one map task are sent by segment in the first place.

Text is worked on in pieces of 1 MiB that overlap by 99 bytes, so memory doesn't grow with a document's length.

Rows: a null or empty text has no bytes and no spans. Strings never cross documents. Of equal strings the one in
the smallest id (nulls last), then at the smallest start, stays. remove_repeats and op4 treat each row as a text of
its own, also where ids are null or shared; equal ids are ordered by a digest of the text. repeated_spans itself
wants unique ids. Further columns are kept by remove_repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogmill.llm.bytescan import PIECE, PrefixHash, mix, pieces, text_bytes
from dialogmill.llm.common import row_keyed, table, written

DEPTH, BLOCK = 100, 32
#: Different segments of one block in a map task, and of one bucket over all tasks, from which on it counts as hot.
HOT_BLOCK, HOT_BUCKET = 64, 2048
#: Segments of whole buckets that are sorted together.
RUN = 20_000
#: Rows that a map task holds before it settles and sends them.
FLUSH = 400_000
SAMPLE, SPAN, SALTED, MARK, OPEN, OPEN_HOT = range(6)
_BITS = np.uint64(22)
_LOW = np.uint64((1 << 22) - 1)
_ODD = np.uint64(0xA24BAED4963EE407)


def windows_of(at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of depth bytes within the rows, and the row of each."""
    count = np.maximum(np.diff(at) - depth + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    first = np.cumsum(count) - count
    return np.arange(len(row)) - first[row] + at[row], row


def segments(data: np.ndarray, at: np.ndarray, depth: int = DEPTH, block: int = BLOCK):
    """Row, first window (byte of the piece), number of windows, block hash and segment hash of each segment."""
    start, row = windows_of(at, depth)
    if len(start) == 0:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    sums = PrefixHash(data)
    here = np.arange(len(data) - block + 1)
    grams = mix(sums.of(here, here + block))
    least = (grams >> _BITS << _BITS) | here.astype(np.uint64)
    width, reach = depth - block + 1, 1
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :]) if width > reach else least
    anchor = (least[start] & _LOW).astype(np.int64)
    new = np.ones(len(start), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    low = start[first]
    high = low + count - 1 + depth
    where = anchor[first]
    name = mix(sums.of(low, high) + ((where - low) * 4096 + count).astype(np.uint64) * _ODD)
    return row[first], low, count, grams[where], name


def merged(doc: np.ndarray, low: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching spans of each document as one."""
    if len(doc) == 0:
        return doc, low, length
    order = np.lexsort((low, doc))
    doc, low, high = doc[order], low[order], (low + length)[order]
    change = np.ones(len(doc), dtype=bool)
    change[1:] = doc[1:] != doc[:-1]
    # running maximum within a document: documents are set apart by an offset
    shift = np.cumsum(change) * (int(high.max()) + 1)
    reach = np.maximum.accumulate(high + shift)
    new = change.copy()
    new[1:] |= low[1:] + shift[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], low[first], reach[last] - shift[last] - low[first]


def later_copies(keys: list[np.ndarray], doc: np.ndarray, low: np.ndarray):
    """Order by keys, doc, low; run starts; which rows start later than their run's first."""
    order = np.lexsort((low, doc, *reversed(keys)))
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = False
        for k in keys:
            new[1:] |= k[order][1:] != k[order][:-1]
    first = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    later = (doc[order] != doc[order][first][run]) | (low[order] != low[order][first][run])
    return order, new, later


SCHEMA = "kind tinyint, a bigint, b bigint, doc bigint, low int, n int"


def rows(kind, a, b, doc, low, n) -> pa.RecordBatch:
    kind = np.full(len(doc), kind, dtype=np.int8) if np.isscalar(kind) else kind
    return pa.RecordBatch.from_arrays(
        [pa.array(kind), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(doc), pa.array(low.astype(np.int32)), pa.array(n.astype(np.int32))],
        names=["kind", "a", "b", "doc", "low", "n"],
    )


def spans_out(doc, low, length):
    doc, low, length = merged(doc, low, length)
    return rows(SPAN, mix(doc.astype(np.uint64)), np.zeros(len(doc), dtype=np.uint64), doc, low, length)


def overlapping(column: pa.Array, ids: np.ndarray, depth: int):
    """Pieces as (ids, offset of each row's first byte in its text, bytes, offsets); long rows in overlapping parts."""
    for low, high, data, at in pieces(column):
        if high - low == 1 and len(data) > PIECE:
            for cut in range(0, max(len(data) - depth + 1, 1), PIECE):
                part = data[cut : cut + PIECE + depth - 1]
                yield ids[low:high], np.array([cut]), part, np.array([0, len(part)])
        else:
            yield ids[low:high], np.zeros(high - low, dtype=np.int64), data, at


def cover_samples(depth: int, block: int):
    """Map side: named samples; copies within the task are settled at once."""

    def settle(held):
        a, b, doc, low, n = (np.concatenate(x) for x in zip(*held))
        order, new, later = later_copies([a, b], doc, low)
        a, b, doc, low, n = a[order], b[order], doc[order], low[order], n[order]
        yield spans_out(doc[later], low[later], n[later] + depth - 1)
        a, b, doc, low, n = a[new], b[new], doc[new], low[new], n[new]
        start = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, dtype=np.int64)
        size = np.diff(np.append(start, len(a)))
        hot = np.repeat(size > HOT_BLOCK, size)
        place = np.arange(len(a)) - np.repeat(start, size)
        plain = ~hot | (place < 2)
        yield rows(np.where(hot[plain], MARK, SAMPLE).astype(np.int8), a[plain], b[plain], doc[plain], low[plain], n[plain])
        if hot.any():
            yield rows(SALTED, b[hot], b[hot], doc[hot], low[hot], n[hot])

    def run(batches):
        held, total = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for who, offset, data, at in overlapping(batch.column(1), ids, depth):
                row, low, count, a, b = segments(data, at, depth, block)
                held.append((a, b, who[row], low - at[row] + offset[row], count))
                total += len(row)
                if total >= FLUSH:
                    yield from settle(held)
                    held, total = [], 0
        if held:
            yield from settle(held)

    return run


def sort_buckets(depth: int):
    """Reduce side, over rows sorted by (a, b, doc, low): later copies give spans, firsts of shared buckets stay open.

    Held between batches: the last row's name with its first row, and the firsts of the last bucket, unless it is hot.
    """

    def opened(a, kind, doc, low, n, hot):
        return rows(np.where(hot, OPEN_HOT, OPEN).astype(np.int8), a, a, doc, low, n)

    def run(batches):
        lead = None  # (a, b, doc, low) of the first row of the last name
        held = None  # a, kind, doc, low, n of the last bucket's firsts
        hot_bucket = None  # the last bucket, if it is hot already
        for batch in batches:
            kind, a, b, doc, low, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            done = kind == SPAN
            if done.any():
                yield spans_out(doc[done], low[done], n[done])
            a, b, kind, doc, low, n = (x[~done] for x in (a, b, kind, doc, low, n))
            if not len(a):
                continue
            new = np.ones(len(a), dtype=bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            goes_on = lead is not None and lead[:2] == (a[0], b[0])
            first, run_of = np.flatnonzero(new), np.cumsum(new) - 1
            lead_doc, lead_low = doc[first], low[first]
            if goes_on:
                lead_doc[0], lead_low[0] = lead[2:]
                new[0] = False
            later = (doc != lead_doc[run_of]) | (low != lead_low[run_of])
            yield spans_out(doc[later], low[later].astype(np.int64), n[later].astype(np.int64) + depth - 1)
            lead = (a[-1], b[-1], lead_doc[-1], lead_low[-1])
            firsts = [x[new] for x in (a, kind, doc, low, n)]
            if hot_bucket is not None and len(firsts[0]) and firsts[0][0] == hot_bucket:
                stop = int(np.argmax(firsts[0] != hot_bucket)) if (firsts[0] != hot_bucket).any() else len(firsts[0])
                yield opened(*(x[:stop] for x in firsts), np.ones(stop, dtype=bool))
                firsts = [x[stop:] for x in firsts]
            if held is not None:
                firsts = [np.concatenate(x) for x in zip(held, firsts)]
            held = None
            if not len(firsts[0]):
                continue
            hot_bucket = None
            start = np.flatnonzero(np.append(True, firsts[0][1:] != firsts[0][:-1]))
            size = np.diff(np.append(start, len(firsts[0])))
            salted = firsts[1] == SALTED
            marked = np.maximum.reduceat((salted | (firsts[1] == MARK)) & True, start) | (size > HOT_BUCKET)
            hot = np.repeat(marked, size)
            still = (np.repeat(size, size) > 1) | salted
            if not marked[-1]:  # the last bucket may go on
                still[start[-1] :] = False
                held = [x[start[-1] :] for x in firsts]
            else:
                hot_bucket = firsts[0][-1]
                still[start[-1] :] = True
            yield opened(*(x[still] for x in firsts), hot[still])
        if held is not None and len(held[0]) > 1:
            yield opened(*held, np.zeros(len(held[0]), dtype=bool))

    return run


def names_of(part: np.ndarray, start: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """128-bit names of the windows of part that begin at start."""
    sums = PrefixHash(part)
    whole, half = sums.of(start, start + depth), sums.of(start, start + depth // 2)
    return mix(whole), mix(half * _ODD + whole)


def places(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All starts low, low + 1, ..., low + n - 1 of each row, one row after the other."""
    return np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


OPEN_SCHEMA = SCHEMA + ", bytes binary"


def with_bytes(batch: pa.RecordBatch, values=None) -> pa.RecordBatch:
    values = pa.nulls(batch.num_rows, pa.binary()) if values is None else values
    return pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, "bytes"])


def open_suffixes(depth: int):
    """Rows (id, text, open list of (kind, a, low, n)) to the bytes of each open segment; hot ones window by window.

    Copies among hot windows within the task are settled.
    """

    def settle(held):
        a, b, doc, low = (np.concatenate(x) for x in zip(*held))
        order, new, later = later_copies([a, b], doc, low)
        a, b, doc, low = a[order], b[order], doc[order], low[order]
        yield with_bytes(spans_out(doc[later], low[later], np.full(int(later.sum()), depth)))
        yield with_bytes(rows(SAMPLE, a[new], b[new], doc[new], low[new], np.full(int(new.sum()), depth)))

    def run(batches):
        held, total = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, at = text_bytes(batch.column(1))
            lists = batch.column(2)
            doc = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
            kind, a, low, n = (lists.flatten().field(k).to_numpy(zero_copy_only=False) for k in ("kind", "a", "low", "n"))
            low, n = low.astype(np.int64), n.astype(np.int64)
            plain = np.flatnonzero(kind == OPEN)
            for cut in range(0, len(plain), 20_000):
                some = plain[cut : cut + 20_000]
                first = at[doc[some]] + low[some]
                raw = data.tobytes() if len(some) > len(data) else None
                parts = [(raw[x : x + y] if raw else data[x : x + y].tobytes()) for x, y in zip(first.tolist(), (n[some] + depth - 1).tolist())]
                yield with_bytes(rows(OPEN, a[some], np.zeros(len(some), dtype=np.int64), ids[doc[some]], low[some], n[some]), pa.array(parts, pa.binary()))
            for i in np.unique(doc[kind == OPEN_HOT]):
                mine = np.flatnonzero((kind == OPEN_HOT) & (doc == i))
                mine = mine[np.argsort(low[mine], kind="stable")]
                text, cut = data[at[i] : at[i + 1]], 0
                while cut < len(mine):
                    stop = max(int(np.searchsorted(low[mine], low[mine[cut]] + PIECE)), cut + 1)
                    some, base = mine[cut:stop], int(low[mine[cut]])
                    start = np.unique(places(low[some] - base, n[some]))
                    held.append((*names_of(text[base : base + int(start[-1]) + depth], start, depth), np.full(len(start), ids[i]), start + base))
                    total += len(start)
                    cut = stop
                if total >= FLUSH:
                    yield from settle(held)
                    held, total = [], 0
        if held:
            yield from settle(held)

    return run


def contexts(data: np.ndarray, first: np.ndarray, step: int, room: np.ndarray, depth: int) -> np.ndarray:
    """For each row the bytes data[first], data[first + step], ..., at most room and depth of them, then zeros."""
    reach = np.arange(-(-depth // 8) * 8)
    place = np.clip(first[:, None] + step * reach, 0, len(data) - 1)
    return np.where(reach < np.minimum(room, depth)[:, None], data[place], 0).astype(np.uint8)


def ranked(bucket: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows by bucket and context, and the length that each has in common with the one before; -1 at a bucket's first."""
    words = context.view(">u8").astype(np.uint64)
    order = np.lexsort((*words.T[::-1], bucket))
    common = np.full(len(order), -1)
    if len(order) > 1:
        same = context[order[1:]] == context[order[:-1]]
        equal = np.where(same.all(axis=1), context.shape[1], same.argmin(axis=1))
        common[1:] = np.where(bucket[order[1:]] == bucket[order[:-1]], equal, -1)
    return order, common


def repeated_windows(bucket, doc, low, n, data, at, depth: int = DEPTH, block: int = BLOCK):
    """doc and start of the windows that start earlier elsewhere in their bucket; rows sorted by (bucket, doc, low).

    A row is a segment: n windows from low on, its bytes, and the hash of the block (bucket) that all of them share.
    """
    rows_of = np.repeat(np.arange(len(n)), np.diff(at))
    here = np.arange(len(data) - block + 1)
    row = rows_of[: len(here)]
    grams = mix(PrefixHash(data).of(here, here + block))
    place = np.flatnonzero((grams == bucket[row]) & (here >= at[row] + n[row] - 1) & (here <= at[row] + depth - block))
    found, which = np.unique(row[place], return_index=True)
    if len(found) != len(n):
        raise ValueError("a segment without its block")
    anchor = place[which]
    before, after = anchor - at[:-1], at[1:] - anchor
    right = ranked(bucket, contexts(data, anchor, 1, after, depth))
    left = ranked(bucket, contexts(data, anchor - 1, -1, before, depth - block))
    rank_r, rank_l = np.empty(len(n), dtype=np.int64), np.empty(len(n), dtype=np.int64)
    who, where = [], []
    for back in range(depth - block + 1):
        mine = np.flatnonzero((back <= before) & (before - back < n))
        if len(mine) < 2:
            continue
        # equal as far as the window reaches on either side
        rank_r[right[0]] = np.cumsum(right[1] < depth - back)
        rank_l[left[0]] = np.cumsum(left[1] < back)
        key = (rank_r[mine] << 32) | rank_l[mine]
        order = np.argsort(key, kind="stable")
        key, mine = key[order], mine[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        lead = np.repeat(mine[first], np.diff(np.append(first, len(key))))
        start = low + before - back
        later = (doc[mine] != doc[lead]) | (start[mine] != start[lead])
        who.append(doc[mine[later]])
        where.append(start[mine[later]])
    return (np.concatenate(who), np.concatenate(where)) if who else (doc[:0], low[:0])


def sort_open(depth: int, block: int = BLOCK):
    """Over rows sorted by (a, b, doc, low): the segments of whole buckets are sorted and their windows settled."""
    singles = sort_windows(depth)

    def run(batches):
        carry = None

        def named():
            """The batch's other rows go on as they are."""
            nonlocal carry
            for batch in batches:
                plain = batch.filter(pa.compute.equal(batch.column(0), OPEN))
                if plain.num_rows:
                    if carry is not None:
                        plain = pa.Table.from_batches([carry, plain]).combine_chunks().to_batches()[0]
                    carry = plain
                    if plain.num_rows >= RUN:
                        a = plain.column(1).to_numpy(zero_copy_only=False)
                        last = int(np.searchsorted(a, a[-1]))
                        yield from whole(plain.slice(0, last))
                        carry = plain.slice(last)
                yield batch.filter(pa.compute.not_equal(batch.column(0), OPEN)).select(range(6))

        def whole(part):
            if part.num_rows:
                a, doc, low, n = (part.column(i).to_numpy(zero_copy_only=False) for i in (1, 3, 4, 5))
                data, at = text_bytes(part.column(6))
                who, where = repeated_windows(a.view(np.uint64), doc, low.astype(np.int64), n.astype(np.int64), data, at, depth, block)
                yield spans_out(who, where, np.full(len(who), depth))

        yield from singles(named())
        if carry is not None:
            yield from whole(carry)

    return run


def sort_windows(depth: int):
    """Over rows sorted by (a, b, doc, low): windows that start later than their name's first give spans."""

    def run(batches):
        last = None
        for batch in batches:
            kind, a, b, doc, low, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            done = kind == SPAN
            if done.any():
                yield spans_out(doc[done], low[done], n[done])
            a, b, doc, low = (x[~done] for x in (a, b, doc, low))
            if not len(a):
                continue
            new = np.ones(len(a), dtype=bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            first = np.flatnonzero(new)
            run_of = np.cumsum(new) - 1
            lead_doc, lead_low = doc[first].copy(), low[first].copy()
            if last is not None and last[:2] == (a[0], b[0]):
                lead_doc[0], lead_low[0] = last[2], last[3]
            later = (doc != lead_doc[run_of]) | (low != lead_low[run_of])
            yield spans_out(doc[later], low[later].astype(np.int64), np.full(int(later.sum()), depth))
            last = (a[-1], b[-1], lead_doc[-1], lead_low[-1])

    return run


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows that can repeat something; built alike wherever it is joined, so that Spark shuffles it once."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text")).where("doc IS NOT NULL")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """doc (the id) and spans (array of (low, n) bytes, may overlap) of every document that has a repeated string."""
    texts = texts_of(docs, id_col, text_col)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = texts.mapInArrow(cover_samples(depth, block), SCHEMA).repartition(parts, "a").sortWithinPartitions("a", "b", "doc", "low")
    settled = written(named.mapInArrow(sort_buckets(depth), SCHEMA).select("kind", F.when(F.col("kind") == OPEN, F.col("a")).alias("a"), "doc", "low", "n"), "suffix-buckets")
    still = settled.where(f"kind <> {SPAN}").groupBy("doc").agg(F.collect_list(F.struct("kind", F.coalesce("a", F.lit(0)).alias("a"), "low", "n")).alias("open"))
    rest = texts.join(still, "doc").select("doc", "text", "open").mapInArrow(open_suffixes(depth), OPEN_SCHEMA)
    rest = rest.repartition(parts, "a").sortWithinPartitions("a", "b", "doc", "low").mapInArrow(sort_open(depth, block), SCHEMA)
    spans = settled.where(f"kind = {SPAN}").select("doc", "low", "n").unionByName(rest.select("doc", "low", "n"))
    return spans.groupBy("doc").agg(F.collect_list(F.struct("low", "n")).alias("spans"))


def cut(data: np.ndarray, low: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, int]:
    """The bytes outside the spans, and the number of maximal removed runs."""
    if not len(low):
        return data, 0
    edge = np.zeros(len(data) + 1, dtype=np.int32)
    np.add.at(edge, low, 1)
    np.add.at(edge, low + n, -1)
    gone = np.cumsum(edge[:-1]) > 0
    runs = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
    return data[~gone], runs


def _cut_rows(batch: pa.RecordBatch, text_at: int, spans_at: int):
    data, at = text_bytes(batch.column(text_at))
    lists = batch.column(spans_at)
    for i in range(batch.num_rows):
        raw = data[at[i] : at[i + 1]]
        inner = lists[i].values if lists[i].is_valid else None
        if inner is None:
            yield raw, raw, 0
        else:
            low, n = (inner.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("low", "n"))
            yield raw, *cut(raw, low, n)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with repeated strings cut out of the text; a character that is cut through goes entirely."""
    keyed, key = row_keyed(docs, id_col, text_col)
    spans = repeated_spans(keyed, key, text_col, **options)
    spans = spans.select(F.col("doc").alias("doc__"), F.col("spans").alias("spans__"))
    joined = keyed.join(spans, keyed[key] == F.col("doc__"), "left").select(*(keyed[c] for c in docs.columns), "spans__")
    columns, text_at, spans_at = docs.columns, docs.columns.index(text_col), len(docs.columns)

    def run(batches):
        for batch in batches:
            texts = [bytes(kept).decode("utf-8", "ignore") for _, kept, _ in _cut_rows(batch, text_at, spans_at)]
            valid = batch.column(text_at).is_valid().to_pylist()
            out = pa.array([x if v else None for x, v in zip(texts, valid)], pa.string())
            yield pa.RecordBatch.from_arrays([out if i == text_at else batch.column(i) for i in range(spans_at)], names=columns)

    return joined.mapInArrow(run, docs.schema)


def op4_suffix_dedup(spark, sf_dir):
    docs, key = row_keyed(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    spans = repeated_spans(docs, key)
    if key == "doc_id":
        joined = texts_of(docs, key, "text").join(spans, "doc", "left").select("doc", "text", "spans")
    else:
        joined = docs.join(spans, docs[key] == spans["doc"], "left").select(F.col("doc_id").cast("bigint"), "text", "spans")

    def run(batches):
        for batch in batches:
            found = [(len(raw), len(raw) - len(kept), runs, hashlib.sha256(kept.tobytes()).hexdigest()) for raw, kept, runs in _cut_rows(batch, 1, 2)]
            columns = list(zip(*found)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(columns[i], pa.int64()) for i in range(3)), pa.array(columns[3], pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return joined.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
