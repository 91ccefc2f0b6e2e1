"""Ids of words that a task has met before, by the bytes of the words."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

#: Words, and bytes of words, that a task remembers; beyond that it starts again with none, or with those that came again. Only speed depends on it.
WORDS, BYTES = 500_000, 1 << 26


class Memo:
    """Encodes each distinct word once. Words are known by their bytes, so different words never share ids.

    keep: when there are too many, words that came again after the piece of text that brought them stay, if they leave
    half of the room to others.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], keep: bool = False):
        self.encode, self.keep = encode, keep
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.size = 0
        self.first = np.zeros(1, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.int32)
        self.again = np.zeros(0, dtype=bool)

    def shrink(self) -> None:
        """Forget the words that did not come again."""
        held = np.flatnonzero(self.again)
        words, first, ids = list(self.known), self.first, self.ids
        kept = [words[i] for i in held.tolist()]
        self.forget()
        if len(kept) <= WORDS // 2 and (size := sum(map(len, kept))) <= BYTES // 2:
            self.known, self.size, self.again = dict(zip(kept, range(len(kept)))), size, np.zeros(len(kept), dtype=bool)
            self.ids, self.first = taken(ids, first, held)

    def learn(self, words: list[bytes]) -> None:
        parts = self.encode(words)
        counts = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        added = np.fromiter(chain.from_iterable(parts), dtype=np.int32, count=int(counts.sum()))
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        self.size += sum(map(len, words))
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(counts)])
        self.ids = np.concatenate([self.ids, added])
        self.again = np.concatenate([self.again, np.zeros(len(words), dtype=bool)])

    def gather(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and the index of each word's first id (and the end)."""
        entry = self.entries(words)
        return taken(self.ids, self.first, entry)

    def gather_array(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for an Arrow array without nulls; each of its distinct words is looked up once."""
        coded = words.dictionary_encode()
        entry = self.entries(coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist())
        return taken(self.ids, self.first, entry[coded.indices.to_numpy()])

    def entries(self, words: list[bytes]) -> np.ndarray:
        entry, new, fresh = self.found(words)
        if len(new):
            if self.keep and self.full(fresh):
                self.shrink()
                entry, new, fresh = self.found(words)
            if self.full(fresh):
                self.forget()
                new, fresh = np.arange(len(words)), list(dict.fromkeys(words))
            self.learn(fresh)
            entry[new] = [self.known[words[i]] for i in new.tolist()]
        return entry

    def found(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """The entry of each word, -1 where it is not known; the places of these, and each of them once."""
        entry = np.fromiter(map(self.known.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        new = np.flatnonzero(entry < 0)
        if self.keep:
            self.again[entry[entry >= 0]] = True
        return entry, new, list(dict.fromkeys(words[i] for i in new.tolist()))

    def full(self, fresh: list[bytes]) -> bool:
        return len(self.known) + len(fresh) > WORDS or self.size > BYTES


def taken(ids: np.ndarray, first: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the entries in a row, and the index of each one's first id (and the end)."""
    count = first[entry + 1] - first[entry]
    total = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
    return ids[np.repeat(first[entry] - total[:-1], count) + np.arange(total[-1])], total
