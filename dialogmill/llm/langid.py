"""Language identification by a byte convolutional network, trained in numpy.

Texts are cut into windows of 256 bytes. Bytes fall into classes (letters without case, digits, spaces, other signs,
each UTF-8 byte above 127). Filters of widths 2, 4 and 6 run over a window's classes; the maximum of each filter over
the window, cut at zero, feeds a softmax over the languages. A text's prediction is the language with the largest
mean log probability over all its windows, weighted by their bytes.

For speed filters are applied to pairs of bytes: a width of 2k is a sum of k rows of tables over pairs, which are
summed from the filters once.

Training takes the texts of at most per_language ids of each language, those with the smallest hashes, and at most six
windows of each, spread over the whole text. Everything else covers all rows and whole texts.

Rows: a null text, or one without a letter, is `und` with score 0. A row with null id is predicted and never learned
from. Null languages are never learned. Without any training text everything is `und`. Repeated rows are predicted
each. Windows of a long text are worked on in pieces. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dialogmill.llm.bytescan import pieces, text_bytes
from dialogmill.llm.common import bucket_of, table

WINDOW, WIDTHS, FILTERS, PER_LANGUAGE, WINDOWS_EACH = 256, (2, 4, 6), 16, 500, 6
_CLASS = np.full(256, 28, dtype=np.int64)
_CLASS[97:123] = np.arange(26)
_CLASS[65:91] = np.arange(26)
_CLASS[48:58] = 26
_CLASS[[32, 9, 10, 11, 12, 13]] = 27
_CLASS[128:] = 29 + np.arange(128)
CLASSES, BLANK = 157, 27
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True


def windows(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes (windows x WINDOW, blanks at the end of a text's last), the text and the bytes of each window."""
    size = np.diff(at)
    count = -(-size // WINDOW)
    owner = np.repeat(np.arange(len(size)), count)
    out = np.full(int(count.sum()) * WINDOW, BLANK, dtype=np.int64)
    shift = (np.cumsum(count) - count) * WINDOW - at[:-1]
    out[np.arange(len(data)) + np.repeat(shift, size)] = _CLASS[data]
    number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return out.reshape(-1, WINDOW), owner, np.minimum(size[owner] - number * WINDOW, WINDOW)


class Network:
    """Filters[width] is width x CLASSES x FILTERS; the last layer has a row for each filter."""

    def __init__(self, languages: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.filters = {w: rng.normal(0, 0.3, (w, CLASSES, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = np.zeros(FILTERS * len(WIDTHS), dtype=np.float32)
        self.last = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
        self.shift = np.zeros(len(languages), dtype=np.float32)
        self.pairs = None

    def tables(self) -> dict[int, list[np.ndarray]]:
        return {w: [(f[i][:, None, :] + f[i + 1][None, :, :]).reshape(-1, FILTERS) for i in range(0, w, 2)] for w, f in self.filters.items()}

    def responses(self, x: np.ndarray, width: int, tables: list[np.ndarray]) -> np.ndarray:
        pair = x[:, :-1] * CLASSES + x[:, 1:]
        n = WINDOW - width + 1
        out = tables[0].take(pair[:, :n], axis=0)
        for k, t in enumerate(tables[1:], 1):
            out += t.take(pair[:, 2 * k : 2 * k + n], axis=0)
        return out

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        if self.pairs is None:
            self.pairs = self.tables()
        out = np.zeros((len(x), len(self.languages)), dtype=np.float32)
        for low in range(0, len(x), 64):  # responses of some windows stay in the cache
            part = x[low : low + 64]
            pooled = np.concatenate([self.responses(part, w, self.pairs[w]).max(axis=1) for w in WIDTHS], axis=1)
            out[low : low + 64] = np.maximum(pooled + self.bias, 0) @ self.last + self.shift
        out -= out.max(axis=1, keepdims=True)
        return out - np.log(np.exp(out).sum(axis=1, keepdims=True))

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.02) -> None:
        rng = np.random.default_rng(5)
        names = [*WIDTHS, "bias", "last", "shift"]
        place = {**self.filters, "bias": self.bias, "last": self.last, "shift": self.shift}
        moment = {k: [np.zeros_like(place[k]), np.zeros_like(place[k])] for k in names}
        weight = 1 / np.maximum(np.bincount(y, minlength=len(self.languages)), 1)
        weight = weight / weight[y].mean()
        t = 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for low in range(0, len(x), batch):
                rows = order[low : low + batch]
                part, want = x[rows], y[rows]
                tables = self.tables()
                tops, spots = [], []
                for w in WIDTHS:
                    r = self.responses(part, w, tables[w])
                    spot = r.argmax(axis=1)
                    spots.append(spot)
                    tops.append(np.take_along_axis(r, spot[:, None, :], axis=1)[:, 0])
                z = np.concatenate(tops, axis=1) + self.bias
                hidden = np.maximum(z, 0)
                logits = hidden @ self.last + self.shift
                p = np.exp(logits - logits.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(rows)), want] -= 1
                p *= (weight[want] / len(rows))[:, None].astype(np.float32)
                grads = {"last": hidden.T @ p, "shift": p.sum(axis=0)}
                down = (p @ self.last.T) * (z > 0)
                grads["bias"] = down.sum(axis=0)
                for k, w in enumerate(WIDTHS):
                    g = np.zeros((w, CLASSES, FILTERS), dtype=np.float32)
                    mine = down[:, k * FILTERS : (k + 1) * FILTERS]
                    for i in range(w):
                        index = np.take_along_axis(part, spots[k] + i, axis=1) * FILTERS + np.arange(FILTERS)
                        g[i] = np.bincount(index.ravel(), weights=mine.ravel(), minlength=CLASSES * FILTERS).reshape(CLASSES, FILTERS)
                    grads[w] = g
                t += 1
                now = rate * (1 - epoch / epochs)
                for k in names:
                    first, second = moment[k]
                    first += 0.1 * (grads[k] - first)
                    second += 0.01 * (grads[k] ** 2 - second)
                    place[k] -= now * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-7)
        self.pairs = None

    def predict(self, data: np.ndarray, at: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        n = len(at) - 1
        best, score = ["und"] * n, np.zeros(n)
        if not self.languages or not len(data):
            return best, score
        totals = np.zeros((n, len(self.languages)))
        for low, high, start, stop in _window_runs(at):
            x, owner, size = windows(data[start:stop], np.clip(at[low : high + 1], start, stop) - start)
            logs = self.log_probabilities(x) * size[:, None]
            for k in range(len(self.languages)):
                totals[low:high, k] += np.bincount(owner, weights=logs[:, k], minlength=high - low)
        mean = totals / np.maximum(np.diff(at), 1)[:, None]
        p = np.exp(mean - mean.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        letters = np.concatenate([[0], np.cumsum(_LETTER[data])])[at]
        for i in range(n):
            if at[i + 1] > at[i] and (letters[i + 1] > letters[i] or regex.search(r"\p{L}", data[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace"))):
                k = int(p[i].argmax())
                best[i], score[i] = self.languages[k], float(p[i, k])
        return best, score


def _window_runs(at: np.ndarray, limit: int = 1 << 20):
    """Row ranges and byte ranges of at most limit bytes; a longer row comes in several."""
    low, n = 0, len(at) - 1
    while low < n:
        high = max(int(np.searchsorted(at, at[low] + limit, side="right")) - 1, low + 1)
        high = min(high, n)
        for start in range(int(at[low]), max(int(at[high]), int(at[low]) + 1), limit):
            yield low, high, start, min(start + limit, int(at[high]))
        low = high


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out=None, per_language: int = PER_LANGUAGE) -> Network:
    known = docs.select(id_col, text_col, lang_col).where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull())
    if held_out is not None:
        known = known.where(~held_out)
    # the ids of each language with the smallest hashes, then one text for each of them
    order = W.partitionBy(lang_col).orderBy(F.xxhash64(id_col), id_col)
    drawn = known.select(id_col, lang_col).withColumn("n__", F.row_number().over(order)).where(F.col("n__") <= per_language).select(id_col, lang_col).distinct()
    chosen = known.join(drawn, [id_col, lang_col], "left_semi").groupBy(id_col, lang_col).agg(F.min(text_col).alias(text_col))

    def cut(batches):
        for batch in batches:
            data, at = text_bytes(batch.column(2))
            out, langs, ids = [], [], []
            for i in range(batch.num_rows):
                raw = data[at[i] : at[i + 1]]
                if not _LETTER[raw].any() and not regex.search(r"\p{L}", raw.tobytes().decode("utf-8", "replace")):
                    continue
                starts = range(0, len(raw), WINDOW)
                step = max(1, -(-len(starts) // WINDOWS_EACH))
                for s in starts[::step]:
                    out.append(raw[s : s + WINDOW].tobytes())
                    langs.append(batch.column(1)[i].as_py())
                    ids.append(batch.column(0)[i].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(langs, pa.string()), pa.array(out, pa.binary())], names=["id", "lang", "bytes"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = chosen.select(id_col, lang_col, text_col).mapInArrow(cut, f"id {kind}, lang string, bytes binary").collect()
    rows.sort(key=lambda r: (r["id"], r["bytes"]))
    languages = sorted({r["lang"] for r in rows})
    network = Network(languages)
    if rows:
        at = np.concatenate([[0], np.cumsum([len(r["bytes"]) for r in rows])])
        x, _, _ = windows(np.frombuffer(b"".join(bytes(r["bytes"]) for r in rows), dtype=np.uint8), at)
        network.train(x, np.array([languages.index(r["lang"]) for r in rows]))
    return network


def identified(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score for each row."""

    def run(batches):
        for batch in batches:
            for low, high, data, at in pieces(batch.column(1)):
                best, score = network.predict(data, at)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(best, pa.string()), pa.array(score, pa.float64())], names=[id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def op10_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = bucket_of("doc_id", 3) == 1
    return identified(docs, train(docs, held_out=out)).select("doc_id", out.alias("held_out"), "lang_pred", "score")
