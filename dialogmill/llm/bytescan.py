"""Vectorised work on the UTF-8 bytes of Arrow text columns.

Bytes are taken straight from the Arrow buffers. Hashes are polynomials modulo 2**64 over a random value for
each byte, read off prefix sums; they are only used for short strings and are mixed afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(20240229)
BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 2**64)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POWERS: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]
#: Bytes of text that are worked on at once; a longer row or word is a piece of its own.
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads each bit over all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((BASE, BASE_INVERSE)):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


class PrefixHash:
    """Hashes of any substrings of one piece of bytes."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        power, self.inverse = powers(n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(BYTE_VALUE[data] * power[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Unmixed hashes of data[start:end]."""
        return (self.sums[end] - self.sums[start]) * self.inverse[start]


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
#: Bytes that are compared eight at a time, piece by piece; what is longer is compared byte by byte.
SHORT = 64


def _alike(data: np.ndarray, begin: np.ndarray, length: np.ndarray, like: np.ndarray) -> bool:
    """Does each piece have the bytes of the piece that like names for it?"""
    if not (length == length[like]).all():
        return False
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    for k in range(0, SHORT, 8):
        some = np.flatnonzero(length > k)
        if not len(some):
            return True
        differ = eight[begin[some] + k] ^ eight[begin[like[some]] + k]
        if (differ & _MASKS[np.minimum(length[some] - k, 8)]).any():
            return False
    some = np.flatnonzero(length > SHORT)
    n, here, there = length[some], begin[some], begin[like[some]]
    inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return bool((data[np.repeat(here, n) + inner] == data[np.repeat(there, n) + inner]).all())


def distinct(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of one of each distinct piece data[begin:end], and for each piece the place of its like among these.

    Pieces are grouped by their hashes, and then compared byte by byte with the one that stands for their group; where
    different pieces have one hash, all are grouped by their bytes instead.
    """
    length = end - begin
    _, where, back = np.unique(mix(PrefixHash(data).of(begin, end) + length.astype(np.uint64)), return_index=True, return_inverse=True)
    same = _alike(data, begin, length, where[back])
    if not same:
        raw, seen = data.tobytes(), {}
        back = np.array([seen.setdefault(raw[i:j], len(seen)) for i, j in zip(begin.tolist(), end.tolist())], dtype=np.int64)
        where = np.unique(back, return_index=True)[1]
    return where, back


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows and the rows' offsets in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, at - at[0]


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges (from, to) with at most limit bytes, or one longer row, and their bytes and offsets."""
    data, at = text_bytes(column)
    start, rows = 0, len(at) - 1
    while start < rows:
        stop = int(np.searchsorted(at, at[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), rows)
        yield start, stop, data[at[start] : at[stop]], at[start : stop + 1] - at[start]
        start = stop


def word_hashes(data: np.ndarray, at: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of the rows, and for each row the index of its first word (and the end)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(at), dtype=np.int64)
    inside = np.zeros(n + 1, dtype=bool)
    inside[:n] = ~SPACE[data]
    begins = inside[:n].copy()
    begins[1:] &= ~inside[: n - 1]
    edges = at[(at > 0) & (at < n)]
    begins[edges] |= inside[edges]
    start = np.flatnonzero(begins)
    ends = inside[:n].copy()
    ends &= ~inside[1:]
    ends[edges - 1] |= inside[edges - 1]
    end = np.flatnonzero(ends) + 1
    out = np.empty(len(start), dtype=np.uint64)
    done = 0
    while done < len(start):
        stop = max(int(np.searchsorted(end, start[done] + PIECE, side="right")), done + 1)
        low, high = start[done], end[stop - 1]
        part = data[low:high]
        sums = PrefixHash(LOWER[part] if lower else part)
        out[done:stop] = sums.of(start[done:stop] - low, end[done:stop] - low) + (end[done:stop] - start[done:stop]).astype(np.uint64)
        done = stop
    return mix(out), np.searchsorted(start, at)
