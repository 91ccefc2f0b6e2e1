"""Quality classifier: Bradley-Terry scores learned from preference pairs.

A document's strength is a sum over features of its whole text, each cut at quantiles into levels with a weight
for each level. Weights come from pairs of a preferred (label 1) and another (label 0) text, by logistic loss on
the difference of their features. The threshold is a quantile of the training strengths, the one with the best
balanced accuracy; scores are the logistic function of the distance to it, set so that a score of 0.3 lies on it.

Labels are learned from at most max_labels labelled rows, those whose ids have the smallest hashes; pairs from at
most max_pairs draws with a fixed seed. Everything else covers all rows.

Rows: a null text counts as empty and is scored like one. A row with null id is scored and is never a training row.
Labels that are null or have no text are left out; without both labels every score is 0.5. Repeated rows are scored
each; of rows that share a labelled id the one with the smallest features is learned from. Very long texts are scanned in pieces. An empty table gives an empty result. Further columns are kept by
keep_good.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogmill.llm.bytescan import mix, pieces, word_hashes
from dialogmill.llm.common import bucket_of, table

FEATURES = ["log_words", "word_length", "symbols", "marks", "points", "upper", "digits", "other", "lines", "distinct_words", "distinct_triples", "top_word", "not_ascii"]
LEVELS, MAX_LABELS, MAX_PAIRS, CUT = 12, 20_000, 60_000, 0.3
_KIND = np.zeros(256, dtype=np.int64)
for _k, _chars in enumerate((b"", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b" \t\x0b\x0c\r", b"\n", b"#*$%&|<>~^=+@_{}[]\\/", b"!?", b".,;:"), 0):
    _KIND[list(_chars)] = _k
_KIND[0x80:0xC0] = 9
_KIND[0xC0:] = 10
_KINDS = 11


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text."""
    n = len(at) - 1
    counts = np.zeros((n, _KINDS))
    step = 1 << 20
    for low in range(0, len(data), step):
        part = data[low : low + step]
        row = np.searchsorted(at, np.arange(low, low + len(part)), side="right") - 1 if n > 1 else np.zeros(len(part), dtype=np.int64)
        counts += np.bincount(row * _KINDS + _KIND[part], minlength=n * _KINDS).reshape(n, _KINDS)
    words, first = word_hashes(data, at)
    n_words = np.diff(first)
    triples = words.copy()
    if len(words) > 2:
        triples[:-2] = mix(words[:-2] + words[1:-1] * np.uint64(3) + words[2:] * np.uint64(7))
    chars = np.maximum(counts.sum(1) - counts[:, 9], 1)
    spaces = counts[:, 4] + counts[:, 5]
    out = np.zeros((n, len(FEATURES)))
    out[:, 0] = np.log1p(n_words)
    out[:, 1] = (chars - spaces) / np.maximum(n_words, 1)
    for k, kind in ((2, 6), (3, 7), (4, 8), (5, 2), (6, 3), (7, 0)):
        out[:, k] = counts[:, kind] / chars
    out[:, 8] = counts[:, 5] / chars
    out[:, 12] = counts[:, 10] / chars
    for i, (low, high) in enumerate(zip(first[:-1], first[1:])):
        if high > low:
            _, times = np.unique(words[low:high], return_counts=True)
            out[i, 9] = len(times) / (high - low)
            out[i, 11] = times.max() / (high - low)
            out[i, 10] = len(np.unique(triples[low : high - 2])) / (high - low - 2) if high - low > 2 else 1
    return out


class Model:
    """Level bounds, weights and threshold; small, and sent to the tasks as it is."""

    def __init__(self, bounds: list[np.ndarray], weights: np.ndarray, threshold: float, scale: float):
        self.bounds, self.weights, self.threshold, self.scale = bounds, weights, threshold, scale

    def strength(self, x: np.ndarray) -> np.ndarray:
        return levels(x, self.bounds) @ self.weights if len(x) else np.zeros(0)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(x), 0.5)
        z = (self.strength(x) - self.threshold) / self.scale
        return np.clip(1 / (1 + np.exp(-np.clip(z, -30, 30)) * (1 - CUT) / CUT), 0, 1)


def levels(x: np.ndarray, bounds: list[np.ndarray]) -> np.ndarray:
    parts = []
    for k, b in enumerate(bounds):
        hot = np.zeros((len(x), len(b) + 1), dtype=np.float32)
        hot[np.arange(len(x)), np.searchsorted(b, x[:, k], side="left")] = 1
        parts.append(hot)
    return np.concatenate(parts, axis=1)


def fit(x: np.ndarray, label: np.ndarray, max_pairs: int = MAX_PAIRS, steps: int = 200, ridge: float = 1e-4) -> Model:
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return Model([], np.zeros(0), 0.0, 1.0)
    rng = np.random.default_rng(1952)
    bounds = []
    for k in range(x.shape[1]):
        # quantiles of either label, so that a rare label has levels of its own
        q = np.linspace(0, 1, LEVELS // 2 + 1)[1:-1]
        bounds.append(np.unique(np.concatenate([np.quantile(x[good, k], q), np.quantile(x[bad, k], q)])))
    hot = levels(x, bounds)
    pairs = min(max_pairs, 40 * max(len(good), len(bad)))
    diff = hot[rng.choice(good, pairs)] - hot[rng.choice(bad, pairs)]
    w, first, second = np.zeros(hot.shape[1], dtype=np.float32), 0.0, 0.0
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
        grad = -(p @ diff) / pairs + ridge * w
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        w = w - 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    s = hot @ w
    cuts = np.quantile(s, np.linspace(0, 1, 401))
    right = [np.mean(s[good] >= c) + np.mean(s[bad] < c) for c in cuts]
    best = np.flatnonzero(np.array(right) >= max(right) - 1e-12)
    # halfway into the gap below the best quantile
    c = cuts[best[len(best) // 2]]
    below = s[s < c]
    threshold = (c + below.max()) / 2 if len(below) else c
    return Model(bounds, w, float(threshold), float(max(np.std(s), 1e-6)))


def text_features(docs: DataFrame, text_col: str = "text", *keep: str) -> DataFrame:
    """keep and x, the features of the whole text."""
    text_at = len(keep)

    def run(batches):
        for batch in batches:
            for low, high, data, at in pieces(batch.column(text_at)):
                x = features(data, at)
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([*part.columns[:text_at], pa.array(list(x), pa.list_(pa.float64()))], names=[*keep, "x"])

    chosen = docs.select(*keep, text_col)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:text_at]] + ["x array<double>"])
    return chosen.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labels: int = MAX_LABELS, held_out=None) -> Model:
    """Fit on at most max_labels labelled rows; held_out is a condition on rows that must not be learned from."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    if held_out is not None:
        known = known.where(~held_out)
    known = known.groupBy(id_col).agg(F.min(label_col).alias("label__")).orderBy(F.xxhash64(id_col), id_col).limit(max_labels)
    texts = docs.select(id_col, text_col).join(F.broadcast(known), id_col)
    # one row for each labelled id, so what comes to the driver is bounded also where rows repeat an id
    rows = text_features(texts, text_col, id_col, "label__").groupBy(id_col, "label__").agg(F.min("x").alias("x")).orderBy(id_col).collect()
    x = np.array([r["x"] for r in rows], dtype=float).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r["label__"] for r in rows], dtype=int))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", out: str = "score") -> DataFrame:
    """id and score of each row."""

    def run(batches):
        for batch in batches:
            for low, high, data, at in pieces(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(model.score(features(data, at)), pa.float64())], names=[id_col, out])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, `{out}` double")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs of a score of at least 0.3, with their columns; scored where they are read, without a join."""
    model = train(docs, labels, id_col, text_col, **options)
    text_at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for low, high, data, at in pieces(batch.column(text_at)):
                yield batch.slice(low, high - low).filter(pa.array(model.score(features(data, at)) >= CUT))

    return docs.mapInArrow(run, docs.schema)


def op2_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = bucket_of("doc_id", 5) == 0
    found = scored(docs, train(docs, labels, held_out=out))
    return found.select("doc_id", out.alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))
