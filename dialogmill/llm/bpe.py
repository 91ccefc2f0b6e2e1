"""Byte-level BPE encoding and decoding over Arrow batches.

Merges come from the tokenizers library's model. Texts are cut into the matches of the vocabulary's pattern with numpy, by
the classes of their characters, and each distinct match is encoded once in a task; the ids of a text are gathered
from those of its matches. Matches are known by their bytes, not by a hash, so that no two share ids. That gives what the
library gives for whole texts, in a seventh of the time.

Offsets: each token has a byte range of the UTF-8 text, and the range of the characters it touches. A character
that is split over tokens lies in the range of each of them. Decoding reverses the byte table and joins bytes
before it decodes UTF-8, so split characters come back whole; ids of a part of a text may start or end within one,
and then give U+FFFD.

Rows: a null or empty text has no tokens. Special token strings are ordinary text. A batch of rows is worked on in
pieces of about 1 MiB; a longer text is a piece of its own. Null ids decode to null. An empty table gives an empty
result. Further columns are kept by encode and decode.
"""

from __future__ import annotations

import hashlib
import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogmill.llm.bytescan import distinct, pieces
from dialogmill.llm.common import table
from dialogmill.llm.memo import Memo

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0


def byte_to_char() -> list[str]:
    """Printable bytes stand for themselves, the others for characters from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


@lru_cache(1)
def char_classes() -> np.ndarray:
    """The class of each code point, as the pattern has them."""
    out = np.zeros(0x110000, dtype=np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for code, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            low, high = ord(m[0][0]), ord(m[0][-1])
            if high - low + 1 == len(m[0]):
                out[low : high + 1] = code
            else:
                out[[ord(c) for c in m[0]]] = code
    return out


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and the byte at which each begins."""
    start = np.flatnonzero((data & 0xC0) != 0x80)
    if len(start) == len(data):
        return data.astype(np.uint32), start
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32), start


def matches(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of the pattern's matches, and for each row the index of its first match (and the end).

    The pattern is that of the vocabulary: contractions 's 't 're 've 'm 'll 'd; runs of letters, of numbers or of
    other signs, each with one space before it; white space, of which the last before a match is left to it.
    """
    n_bytes = len(data)
    if n_bytes == 0:
        return np.zeros(0, dtype=np.int64), np.zeros(len(at), dtype=np.int64)
    points, byte = code_points(data)
    n = len(points)
    kind = char_classes()[points]
    edge = np.zeros(n + 1, dtype=bool)
    edge[np.searchsorted(byte, at)] = True  # the rows' bounds
    start = edge.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    start[n] = True
    run = np.flatnonzero(start)
    run_kind = np.append(kind[run[:-1]], 9)
    begins = start.copy()
    # the last character of white space before other characters of the row goes alone or to what follows
    space = np.flatnonzero(run_kind[:-1] == SPACE)
    follows = space[~edge[run[space + 1]]]
    last = run[follows + 1] - 1
    begins[last] = True
    joined = last[points[last] == 32]
    begins[joined + 1] = False
    # contractions: a sign run that is just an apostrophe without a space taken before, then the letters
    sign = np.flatnonzero((run_kind[:-1] == OTHER) & (np.diff(run) == 1))
    sign = sign[(points[run[sign]] == 39) & begins[run[sign]] & (run_kind[sign + 1] == LETTER)]
    sign = sign[~edge[run[sign + 1]]]
    if len(sign):
        quote = run[sign]
        end = run[sign + 2]
        one = points[quote + 1]
        two = np.where(quote + 2 < end, points[np.minimum(quote + 2, n - 1)], 0)
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for found, size in ((single, 1), (double & ~single, 2)):
            q, e = quote[found], end[found]
            begins[q + 1] = False
            rest = q + 1 + size
            begins[rest[rest < e]] = True
    begin = byte[np.flatnonzero(begins[:n])]
    return begin, np.searchsorted(begin, at)


class Encoder:
    """Ids of whole texts by a tokenizer file; each distinct match is merged once, and known by its bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model, table = Tokenizer.from_file(path).model, dict(enumerate(byte_to_char()))
        # the library's model takes matches in characters of the byte table
        self.memo = Memo(lambda words: [[t.id for t in model.tokenize(w.decode("latin-1").translate(table))] for w in words])

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, and for each row the index of its first id (and the end)."""
        begin, row_first = matches(data, at)
        if not len(begin):
            return np.zeros(0, dtype=np.int32), np.zeros(len(at), dtype=np.int64)
        end = np.append(begin[1:], len(data))
        where, back = distinct(data, begin, end)
        raw = data.tobytes()
        ids, first = self.memo.gather([raw[i:j] for i, j in zip(begin[where].tolist(), end[where].tolist())])
        count = np.diff(first)[back]
        total = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
        return ids[np.repeat(first[back] - total[:-1], count) + np.arange(total[-1])], total[row_first]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(2)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id, by the byte table in reverse; special tokens as their UTF-8 text."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    back = {c: b for b, c in enumerate(byte_to_char())}
    special = {x["id"] for x in data.get("added_tokens", [])}
    vocab = data["model"]["vocab"] | {x["content"]: x["id"] for x in data.get("added_tokens", [])}
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = token.encode() if i in special else bytes(back[c] for c in token)
    return out


@lru_cache(2)
def token_lengths(path: str) -> np.ndarray:
    return np.array([len(x) for x in token_bytes(path)], dtype=np.int64)


def offsets(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte and character ranges of a text's tokens; a split character counts for each token that has a part of it."""
    end = np.cumsum(lengths)
    begin = end - lengths
    char = np.cumsum((data & 0xC0) != 0x80)  # at a byte: the number of its character
    return begin, end, char[begin] - 1, char[end - 1]


def encode(docs: DataFrame, path: str, text_col: str = "text", with_offsets: bool = True) -> DataFrame:
    """docs with ids and, if wanted, byte_start, byte_end, char_start, char_end arrays."""
    names = ["ids", *(["byte_start", "byte_end", "char_start", "char_end"] if with_offsets else [])]
    kept = docs.drop(*names)
    columns, text_at = kept.columns, kept.columns.index(text_col)

    def run(batches):
        enc, lengths = encoder(path), token_lengths(path)
        for batch in batches:
            for low, high, data, at in pieces(batch.column(text_at)):
                ids, first = enc.encode(data, at)
                out = [pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()))]
                if with_offsets:
                    found = [offsets(data[at[i] : at[i + 1]], lengths[ids[first[i] : first[i + 1]]]) if at[i + 1] > at[i] else (np.zeros(0, np.int64),) * 4 for i in range(high - low)]
                    out += [pa.array([f[k].astype(np.int32) for f in found], pa.list_(pa.int32())) for k in range(4)]
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([*part.columns, *out], names=[*columns, *names])

    return kept.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + [f"{n} array<int>" for n in names]))


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """encoded with the text of its ids; bytes that are no whole character give U+FFFD."""
    encoded = encoded.drop(out)
    columns, at = encoded.columns, encoded.columns.index(ids_col)

    def run(batches):
        parts = token_bytes(path)
        for batch in batches:
            texts = [None if x is None else b"".join([parts[i] for i in x]).decode("utf-8", "replace") for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*columns, out])

    return encoded.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema] + [f"{out} string"]))


def op3_bpe(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def run(batches):
        enc, parts = encoder(path), token_bytes(path)
        digits = [b"%d" % i for i in range(len(parts))]
        for batch in batches:
            for low, high, data, at in pieces(batch.column(1)):
                ids, first = enc.encode(data, at)
                listed = ids.tolist()
                rows = [listed[a:b] for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, high - low),
                        pa.array(np.diff(first), pa.int64()),
                        pa.array([hashlib.sha256(b" ".join([digits[i] for i in x])).hexdigest() for x in rows], pa.string()),
                        pa.array([hashlib.sha256(b"".join([parts[i] for i in x])).hexdigest() for x in rows], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kept = F.col("doc_id").cast("bigint").alias("doc_id")
    return docs.select(kept, "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
