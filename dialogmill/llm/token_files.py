"""Token ids in Arrow files of equal-length sequences, as a data source that Spark writes and reads.

A part holds the ids of a range of documents, one after the other, cut into sequences of `length` ids. It is an Arrow
file (the stream format with a footer) of record batches of `batch` sequences each, with two columns of fixed-size
lists: ids (of 16 bits where the vocabulary fits in, else 32), and mask (a bit for each place: set for an id, not for the
padding of the part's last sequence). Lists of fixed size lie in one buffer without offsets, so sequence k is a slice of batch k // batch of the mapped file, and is read without a copy
or a search (Part.sequence). A second Arrow file beside it has a row for each document: its id and place in the part.

* Documents are put in order by ranges of their ids, so parts follow one another; texts are shuffled once, and ids
  not at all: the task that sorts a range encodes it and writes its part.
* A task writes parts under names of its own. Only when all tasks are done, the manifest names the parts that count, with
  the number of ids before each. Parts of failed or repeated tasks are never named, and readers see all or nothing.
* Files go through Arrow's file systems, by the scheme of the path (file, hdfs, s3, gs).
* Each distinct word between white space is encoded once in a task by the tokenizers library, which drops white space in
  this vocabulary and never looks across it; words are known by their bytes. Words of Latin letters go straight to the
  library's model, as its other steps cost four times as much.

Rows: a null or empty text is its end id alone. Null ids come last; rows that share an id are ordered by their text, and
equal rows are written each. Special token strings are ordinary text. An empty table gives a manifest without parts.
Further columns are not written.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from dialogmill.llm.bpe import byte_to_char
from dialogmill.llm.bytescan import pieces
from dialogmill.llm.common import shared_dir, table
from dialogmill.llm.memo import Memo

FORMAT, MANIFEST = "token_sequences", "_manifest.arrow"
LENGTH, BATCH, END_ID = 2048, 256, 2
DOCS = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64())])
PARTS = pa.schema([("part", pa.string()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("n_docs", pa.int64())])
#: Documents of a record batch of a part's second file, and bytes of ids that a reader gives out at once.
DOC_ROWS, READ_BYTES = 10_000, 1 << 22
#: The first character after the Latin letters.
LATIN = "\u0250"


def folder(path: str) -> tuple[pa.fs.FileSystem, str]:
    files, inner = pa.fs.FileSystem.from_uri(path)
    # files on a disk are mapped, not read
    return (pa.fs.LocalFileSystem(use_mmap=True) if isinstance(files, pa.fs.LocalFileSystem) else files), inner


def _sequences(length: int, bits: int) -> pa.Schema:
    ids = pa.uint16() if bits == 16 else pa.uint32()
    return pa.schema([("ids", pa.list_(pa.field("id", ids, nullable=False), length)), ("mask", pa.list_(pa.field("on", pa.bool_(), nullable=False), length))])


def read_manifest(path: str) -> pa.Table:
    files, inner = folder(path)
    with files.open_input_file(f"{inner}/{MANIFEST}") as f:
        return pa.ipc.open_file(f).read_all()


class Part:
    """One part, open for reading."""

    def __init__(self, path: str, name: str):
        files, inner = folder(path)
        self.file = pa.ipc.open_file(files.open_input_file(f"{inner}/{name}.arrow"))
        self.documents = pa.ipc.open_file(files.open_input_file(f"{inner}/{name}.docs.arrow"))
        self.length = self.file.schema.field("ids").type.list_size
        self.batch = int(self.file.schema.metadata[b"batch"])

    def values(self, k: int) -> np.ndarray:
        """All ids of record batch k in a row, without a copy."""
        return self.file.get_batch(k).column("ids").flatten().to_numpy(zero_copy_only=True)

    def sequence(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of sequence k, as views of the file."""
        low, rows = k % self.batch * self.length, self.file.get_batch(k // self.batch)
        return rows.column("ids").flatten().to_numpy(zero_copy_only=True)[low : low + self.length], rows.column("mask").flatten().slice(low, self.length)

    def masked(self) -> int:
        """How many places hold an id."""
        return sum(self.file.get_batch(k).column("mask").flatten().true_count for k in range(self.file.num_record_batches))

    def ids(self, first: int, n: int) -> np.ndarray:
        """Ids from any place on; a copy only where they lie in several batches."""
        size = self.batch * self.length
        found = [self.values(k)[max(first - k * size, 0) : first + n - k * size] for k in range(first // size, -(-(first + n) // size))]
        return found[0] if len(found) == 1 else np.concatenate([np.zeros(0, np.uint16), *found])


@dataclass
class Written(WriterCommitMessage):
    order: int
    part: str
    n_tokens: int
    n_docs: int


class TokenWriter(DataSourceArrowWriter):
    """Writes rows (id, ids) in the order in which they come."""

    def __init__(self, path: str, length: int, batch: int, bits: int):
        self.path, self.length, self.batch, self.bits = path, length, batch, bits

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, inner = folder(self.path)
        order = TaskContext.get().partitionId()
        name, size = f"part-{order:06d}-{uuid.uuid4().hex}", self.length * self.batch
        schema, kind = _sequences(self.length, self.bits), np.uint16 if self.bits == 16 else np.uint32
        total = docs = held = 0
        pending: list[np.ndarray] = []
        writer = index = None
        outs: list = []

        def emit(ids: np.ndarray) -> None:
            rows = -(-len(ids) // self.length)
            padded = np.zeros(rows * self.length, dtype=kind)
            padded[: len(ids)] = ids
            mask = np.arange(len(padded)) < len(ids)
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(v), type=f.type) for v, f in zip((padded, mask), schema)]
            writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=schema))

        for rows in iterator:
            if writer is None and rows.num_rows:
                files.create_dir(inner, recursive=True)
                outs = [files.open_output_stream(f"{inner}/{name}{end}") for end in (".arrow", ".docs.arrow")]
                schema = schema.with_metadata({"batch": str(self.batch)})
                writer, index = pa.ipc.new_file(outs[0], schema), pa.ipc.new_file(outs[1], DOCS)
            at = rows.column(1).offsets.to_numpy()
            ids = rows.column(1).values.to_numpy()[at[0] : at[-1]] if rows.num_rows else np.zeros(0, np.int32)
            if len(ids) and not 0 <= ids.min() <= ids.max() < 1 << self.bits:
                raise ValueError(f"ids beyond {self.bits} bits")
            ids = ids.astype(kind)
            for low in range(0, rows.num_rows, DOC_ROWS):
                part, places = rows.column(0).slice(low, DOC_ROWS), at[low : low + DOC_ROWS + 1].astype(np.int64)
                index.write_batch(pa.RecordBatch.from_arrays([part, pa.array(total + places[:-1] - at[0]), pa.array(np.diff(places))], schema=DOCS))
            docs, total = docs + rows.num_rows, total + len(ids)
            while held + len(ids) >= size:
                take = size - held
                emit(np.concatenate([*pending, ids[:take]]))
                pending, held, ids = [], 0, ids[take:]
            if len(ids):
                pending.append(ids)
                held += len(ids)
        if writer is not None:
            if held:
                emit(np.concatenate(pending))
            for x in (writer, index, *outs):
                x.close()
        return Written(order, name if writer is not None else "", total, docs)

    def commit(self, messages: list) -> None:
        """Name the parts that count, with the number of ids before each; a row for each task."""
        parts = sorted((m for m in messages if m is not None and m.part), key=lambda m: m.order)
        starts = np.concatenate([[0], np.cumsum([m.n_tokens for m in parts])]).astype(np.int64)[: len(parts)]
        rows = pa.table([[m.part for m in parts], starts, [m.n_tokens for m in parts], [m.n_docs for m in parts]], schema=PARTS)
        files, inner = folder(self.path)
        files.create_dir(inner, recursive=True)
        hidden = f"{inner}/.{uuid.uuid4().hex}"
        with files.open_output_stream(hidden) as f, pa.ipc.new_file(f, PARTS) as out:
            out.write_table(rows)
        files.move(hidden, f"{inner}/{MANIFEST}")

    def abort(self, messages: list) -> None:
        files, inner = folder(self.path)
        for m in messages:
            for end in (".arrow", ".docs.arrow") if m is not None and m.part else ():
                files.delete_file(f"{inner}/{m.part}{end}")


@dataclass
class PartRows(InputPartition):
    part: str
    start: int
    n_tokens: int
    n_before: int


class TokenReader(DataSourceReader):
    """Rows of the parts that the manifest names: documents, or sequences."""

    def __init__(self, path: str, view: str):
        self.path, self.view = path, view

    def partitions(self) -> list[PartRows]:
        parts = read_manifest(self.path).to_pylist()
        length = Part(self.path, parts[0]["part"]).length if parts else 1
        out, before = [], 0
        for p in parts:
            out.append(PartRows(p["part"], p["start"], p["n_tokens"], before))
            before += -(-p["n_tokens"] // length)
        return out or [PartRows("", 0, 0, 0)]

    def read(self, partition: PartRows) -> Iterator[pa.RecordBatch]:
        if partition.part:
            part = Part(self.path, partition.part)
            yield from self._documents(part, partition) if self.view == "documents" else self._rows(part, partition)

    def _documents(self, part: Part, of: PartRows) -> Iterator[pa.RecordBatch]:
        if part.masked() != of.n_tokens:
            raise ValueError(f"{of.part} has {part.masked()} ids, not {of.n_tokens}")
        for b in range(part.documents.num_record_batches):
            rows = part.documents.get_batch(b)
            first, n = (rows.column(c).to_numpy() for c in (1, 2))
            low = 0
            while low < len(n):
                # documents that follow one another are one piece of ids
                high = max(int(np.searchsorted(first + n, first[low] + READ_BYTES // 4, side="right")), low + 1)
                ids = part.ids(int(first[low]), int(n[low:high].sum())).astype("<u4")
                places = np.concatenate([first[low:high], [first[high - 1] + n[high - 1]]]) - first[low]
                kind = pa.large_binary() if places[-1] * 4 >= 2**31 else pa.binary()
                at = pa.py_buffer((places * 4).astype(np.int64 if kind == pa.large_binary() else np.int32))
                packed = pa.Array.from_buffers(kind, high - low, [None, at, pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([rows.column(0).slice(low, high - low), pa.array(of.start + first[low:high]), pa.array(n[low:high]), packed], names=["doc_id", "start", "n_tokens", "ids"])
                low = high

    def _rows(self, part: Part, of: PartRows) -> Iterator[pa.RecordBatch]:
        done = of.n_before
        for b in range(part.file.num_record_batches):
            rows = part.file.get_batch(b)
            number = pa.array(np.arange(done, done + rows.num_rows))
            lists = [rows.column(c).cast(pa.list_(pa.int32())) for c in ("ids", "mask")]
            yield pa.RecordBatch.from_arrays([number, *lists], names=["sequence", "ids", "mask"])
            done += rows.num_rows


class TokenSequences(DataSource):
    """Options: path; for writing length, batch and bits (of an id: 16 or 32); for reading view (documents or sequences)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        if self.options.get("view", "documents") == "documents":
            return "doc_id bigint, start bigint, n_tokens bigint, ids binary"
        return "sequence bigint, ids array<int>, mask array<int>"

    def writer(self, schema, overwrite: bool) -> TokenWriter:
        return TokenWriter(self.options["path"], int(self.options.get("length", LENGTH)), int(self.options.get("batch", BATCH)), int(self.options.get("bits", 32)))

    def reader(self, schema) -> TokenReader:
        return TokenReader(self.options["path"], self.options.get("view", "documents"))


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


@lru_cache(2)
def word_memo(path: str) -> Memo:
    """Ids of words between white space, by a tokenizer file that drops white space."""
    tokenizer, table = _tokenizer(path), dict(enumerate(byte_to_char()))
    with open(path, encoding="utf-8") as f:
        pattern = json.load(f)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
    cut, model = regex.compile(pattern), tokenizer.model

    def encode(words: list[bytes]) -> list[list[int]]:
        out = []
        for word in words:
            text = word.decode("utf-8")
            if word.isalpha():  # ASCII letters
                out.append([t.id for t in model.tokenize(text.lower())])
            elif text.isascii() and text.isprintable():
                low = text.lower()
                out.append([t.id for piece in cut.findall(low) for t in model.tokenize(piece)])
            elif text.isprintable() and max(text) < LATIN:  # these need no normal form, and every version of Unicode has them in one class
                out.append([t.id for piece in cut.findall(text.lower()) for t in model.tokenize(piece.encode().decode("latin-1").translate(table))])
            else:
                out.append(tokenizer.encode(text, add_special_tokens=False).ids)
        return out

    return Memo(encode, keep=True)


def split_words(data: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII white space of all rows (empty ones may be among them), and the index of each row's first (and the end).

    A-Z is in lower case, unless there is a combining mark (U+0300 to U+036F): t and a diaeresis have a composed form, T has none.
    """
    texts = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    if not ((data == 0xCC) | (data == 0xCD)).any():
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    return lists.values, lists.offsets.to_numpy()


def encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, ids) of docs (doc_id, text), with the end id; rows keep their order."""

    def run(batches):
        memo = word_memo(tokenizer)
        for batch in batches:
            for low, high, data, at in pieces(batch.column(1)):
                words, places = split_words(data, at)
                ids, first = memo.gather_array(words)
                ends = first[places[1:]]
                ids = np.insert(ids, ends, end_id)
                at_ids = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.ListArray.from_arrays(pa.array(at_ids, pa.int32()), pa.array(ids, pa.int32()))], names=["doc_id", "ids"])

    return docs.mapInArrow(run, "doc_id bigint, ids array<int>")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, length: int = LENGTH, batch: int = BATCH) -> None:
    """The ids of all texts, each with the end id, in ascending order of id_col."""
    docs.sparkSession.dataSource.register(TokenSequences)
    named = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    # equal rows may lie in several ranges
    order = [F.col("doc_id").asc_nulls_last(), F.col("hash__"), F.col("tie__")]
    placed = named.withColumns({"hash__": F.xxhash64("text"), "tie__": F.monotonically_increasing_id()})
    placed = placed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    bits = 16 if max(_tokenizer(tokenizer).get_vocab_size() - 1, end_id) < 1 << 16 else 32
    encoded(placed, tokenizer, end_id).write.format(FORMAT).mode("append").option("bits", bits).option("length", length).option("batch", batch).save(path)


def read_tokens(spark: SparkSession, path: str, view: str = "documents") -> DataFrame:
    """documents: (doc_id, start, n_tokens, ids as little-endian 32-bit numbers); sequences: (sequence, ids, mask)."""
    spark.dataSource.register(TokenSequences)
    return spark.read.format(FORMAT).option("view", view).load(path)


def op12_token_files(spark, sf_dir):
    import public_tokenizers

    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
