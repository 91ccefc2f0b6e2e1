"""Packing of token sequences by Karmarkar-Karp multiway differencing.

Each task packs the documents of its partition as they come. A document's whole windows are pieces of their own;
what is left over is collected into blocks of about `windows` windows. A block's pieces are partitioned by the
largest differencing method: partial partitions are merged, each time the two with the largest imbalance, largest
sums against smallest, until one partition into near-equal windows is left. Whenever a window exceeds the capacity
the window count rises and the block is differenced again. A block is filled to just under its capacity by cutting
the document at its end, and pieces are cut to at most `piece` tokens first, so that windows come out near-equal.

No row leaves its task and nothing is shuffled; each partition ends with one block that may be less full.
sequence_id is the partition's number times 2**36, plus the window's number in it.

Rows: a null or empty text is its end id alone. Null ids are packed and stay null. Rows that share an id, repeated rows too, are
packed each on its own: a piece never holds ids of two rows.
An empty table gives no pieces. Further columns are not read.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogmill.llm.bpe import encoder
from dialogmill.llm.bytescan import pieces as text_pieces
from dialogmill.llm.common import table

CAPACITY, END_ID = 2048, 1
WINDOWS, PIECE, SLACK = 64, 512, 2


def differencing(sizes: list[int], windows: int) -> np.ndarray:
    """The window of each size, in `windows` windows of near-equal sums (largest differencing method)."""
    n = len(sizes)
    sums = [np.zeros(windows, dtype=np.int64) for _ in range(n)]
    for s, size in zip(sums, sizes):
        s[-1] = size
    heap = [(-size, i) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    merges = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = sums[a] + sums[b][::-1]
        order = both.argsort(kind="stable")
        both = both[order]
        both -= both[0]
        heapq.heappush(heap, (-int(both[-1]), len(sums)))
        merges.append((a, b, order))
        sums.append(both)
    # from the last partition back: where the windows of both parts went
    where = {len(sums) - 1: np.arange(windows)}
    for k in range(len(merges) - 1, -1, -1):
        a, b, order = merges[k]
        of_a = np.empty(windows, dtype=np.int64)
        of_a[order] = where.pop(n + k)
        where[a], where[b] = of_a, of_a[::-1]
    return np.array([where[i][-1] for i in range(n)], dtype=np.int64)


class Packer:
    """Pieces of documents into sequences; a piece is (row, doc, start, ids, doc_tokens), row being the document's number in the task."""

    def __init__(self, capacity: int, windows: int, piece: int, slack: int, base: int):
        self.capacity, self.windows, self.piece, self.slack, self.next = capacity, windows, piece, slack, base
        self.held: list[tuple] = []
        self.total = self.rows = 0
        self.out: list[tuple] = []

    def emit(self, group: list[tuple]) -> None:
        offset = 0
        for _, doc, start, ids, total in group:
            self.out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, offset))
            offset += len(ids)
        self.next += 1

    def add(self, doc, ids: np.ndarray) -> None:
        total, row = len(ids), self.rows
        self.rows += 1
        whole = total - total % self.capacity
        for start in range(0, whole, self.capacity):
            self.emit([(row, doc, start, ids[start : start + self.capacity], total)])
        if whole < total:
            self.hold(row, doc, whole, ids[whole:], total)

    def hold(self, row: int, doc, start: int, ids: np.ndarray, total: int) -> None:
        target = self.windows * (self.capacity - self.slack)
        room = target - self.total
        if len(ids) >= room:
            if room:
                self.held.append((row, doc, start, ids[:room], total))
                self.total += room
            self.close()
            start, ids = start + room, ids[room:]
        if len(ids):
            self.held.append((row, doc, start, ids, total))
            self.total += len(ids)

    def close(self) -> None:
        """Difference the held pieces into windows."""
        if not self.held:
            return
        cut = [(row, doc, start + i, ids[i : i + self.piece], total) for row, doc, start, ids, total in self.held for i in range(0, len(ids), self.piece)]
        sizes = [len(x[3]) for x in cut]
        windows = max(1, -(-self.total // self.capacity))
        while True:
            window = differencing(sizes, windows)
            if np.bincount(window, weights=sizes).max() <= self.capacity:
                break
            windows += 1
        groups: dict[int, list[tuple]] = {}
        for w, x in zip(window.tolist(), cut):
            groups.setdefault(w, []).append(x)
        for w in sorted(groups):
            self.emit(self.joined(groups[w]))
        self.held, self.total = [], 0

    @staticmethod
    def joined(group: list[tuple]) -> list[tuple]:
        """Pieces of one row that follow one another are one piece again."""
        out: list[tuple] = []
        for piece in group:
            row, doc, start, ids, total = piece
            if out and out[-1][0] == row and out[-1][2] + len(out[-1][3]) == start:
                out[-1] = (row, doc, out[-1][2], np.concatenate([out[-1][3], ids]), total)
            else:
                out.append(piece)
        return out

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.out)) or [[] for _ in range(7)]
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, windows: int = WINDOWS, piece: int = PIECE, slack: int = SLACK) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece."""

    def run(batches):
        enc = encoder(path)
        packer = Packer(capacity, windows, piece, slack, TaskContext.get().partitionId() << 36)
        for batch in batches:
            for low, high, data, at in text_pieces(batch.column(1)):
                ids, first = enc.encode(data, at)
                docs_here = batch.column(0).slice(low, high - low).to_pylist()
                for i, doc in enumerate(docs_here):
                    packer.add(doc, np.append(ids[first[i] : first[i + 1]], np.int32(end_id)))
                if packer.out:
                    yield packer.batch()
        packer.close()
        if packer.out:
            yield packer.batch()

    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def op7_packing(spark, sf_dir):
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
