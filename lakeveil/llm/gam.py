"""Quality classifier: a generalised additive model with pairwise interactions.

Features are numbers read off the whole text. Cyclic boosting visits one feature after the other with shallow trees
on its bins, then the strongest pairs with four-cell trees; the trees add up to a lookup table per feature and pair.
A score is the logistic function of the intercept and the tables' entries at the text's bins.

The model is fitted on the rows of at most SAMPLE labelled training keys (those whose hash of key and label lies under a
threshold, which is set by their number; 2 SAMPLE rows at most, if keys occur more than once), a documented bound; features and scores cover all rows.

Null and empty texts have the features of an empty text and get a score. Null keys, null labels and keys without a
label train nothing; a key with several labels trains once with each different one. Without training rows every score is 0.5. Every
row gives one row, repeated rows too.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import column, per_slice, texts

SAMPLE = 20_000
BINS = 32
PAIR_BINS = 8
ROUNDS = 120
PAIRS = 6
RATE = 0.15
THRESHOLD = 0.3

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "lower", "digit", "stop_comma", "exclaim", "mark", "bar", "quote", "bracket", "other_ascii", "non_ascii",
    "distinct_words", "distinct_pairs", "top_word", "short_words", "long_words", "log_lines", "line_bytes", "distinct_lines", "words_with_mark", "capitals",
)


def of_bytes(chars: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(chars, np.uint8), minlength=256) > 0


#: Byte classes whose share of the text is a feature.
CLASSES = np.array([
    of_bytes(bytes(range(65, 91))), of_bytes(bytes(range(97, 123))), of_bytes(b"0123456789"), of_bytes(b".,;:?"), of_bytes(b"!"), of_bytes(b"#$%&*@^~+="),
    of_bytes(b"|"), of_bytes(b"\"'`"), of_bytes(b"()[]{}<>"), of_bytes(b"/\\_-"), of_bytes(bytes(range(128, 256))),
]).astype(float).T


def features_of(text: bytes) -> list[float]:
    n = len(text)
    shares = (np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ CLASSES / max(1, n)).tolist()
    words = text.split()
    k = len(words)
    lines = [x for x in text.split(b"\n") if x]
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, k)
    some = max(1, k)
    marked = sum(not w[-1:].isalnum() and w[-1] < 128 for w in words)
    return [
        math.log1p(n), math.log1p(k), n / some, *shares,
        len(counts) / some, len(set(zip(words, words[1:]))) / max(1, k - 1), max(counts.values(), default=0) / some,
        float((lengths <= 3).sum()) / some, float((lengths > 12).sum()) / some,
        math.log1p(len(lines)), math.log1p(n / max(1, len(lines))), len(set(lines)) / max(1, len(lines)), marked / some, sum(w[:1].isupper() for w in words) / some,
    ]


@dataclass
class Gam:
    intercept: float
    cuts: np.ndarray  # feature x bin edges
    tables: np.ndarray  # feature x bins
    pairs: list[tuple[int, int]]
    pair_tables: np.ndarray  # pair x bins x bins, of coarse bins

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for rows of features: additions of table entries."""
        bins = binned(x, self.cuts)
        total = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            total += table[bins[:, j]]
        for (a, b), table in zip(self.pairs, self.pair_tables):
            total += table[bins[:, a] * PAIR_BINS // BINS, bins[:, b] * PAIR_BINS // BINS]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def binned(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(cuts[j], x[:, j], side="right") for j in range(len(cuts))], axis=1) if len(x) else np.zeros((0, len(cuts)), np.int64)


def shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Steps per bin of a tree with up to three leaves over a feature's bins."""
    cuts = [0, len(g)]
    for _ in range(2):
        best, at = 1e-9, None
        for a, b in zip(cuts, cuts[1:]):
            if b - a < 2:
                continue
            gs, hs = np.cumsum(g[a:b]), np.cumsum(h[a:b])
            left, right = gs[:-1] ** 2 / (hs[:-1] + 1), (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1)
            gain = left + right - gs[-1] ** 2 / (hs[-1] + 1)
            i = int(gain.argmax())
            if gain[i] > best:
                best, at = gain[i], a + i + 1
        if at is None:
            break
        cuts = sorted([*cuts, at])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def four_cells(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and steps of the best tree with one cut on each axis of a pair's cells."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a, b = G[:-1, :-1], H[:-1, :-1]
    parts = [(a, b), (G[:-1, -1:] - a, H[:-1, -1:] - b), (G[-1:, :-1] - a, H[-1:, :-1] - b), (G[-1, -1] - G[:-1, -1:] - G[-1:, :-1] + a, H[-1, -1] - H[:-1, -1:] - H[-1:, :-1] + b)]
    gain = sum(x**2 / (y + 1) for x, y in parts)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    steps = np.zeros(g.shape)
    for (x, y), cell in zip(parts, (np.s_[: i + 1, : j + 1], np.s_[: i + 1, j + 1 :], np.s_[i + 1 :, : j + 1], np.s_[i + 1 :, j + 1 :])):
        steps[cell] = x[i, j] / (y[i, j] + 1)
    return float(gain[i, j]), steps


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pairs: int = PAIRS) -> Gam:
    d = x.shape[1]
    if not len(x):
        return Gam(0.0, np.zeros((d, BINS - 1)), np.zeros((d, BINS)), [], np.zeros((0, PAIR_BINS, PAIR_BINS)))
    cuts = np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T.copy()
    bins = binned(x, cuts)
    share = (y.sum() + 0.5) / (len(y) + 1)
    intercept = math.log(share / (1 - share))
    total, tables = np.full(len(x), intercept), np.zeros((d, BINS))

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(d):
            g, h = slopes()
            step = RATE * shallow_tree(np.bincount(bins[:, j], g, BINS), np.bincount(bins[:, j], h, BINS))
            tables[j] += step
            total += step[bins[:, j]]
    coarse = bins * PAIR_BINS // BINS
    cells = lambda a, b, w: np.bincount(coarse[:, a] * PAIR_BINS + coarse[:, b], w, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
    g, h = slopes()
    found = sorted(((four_cells(cells(a, b, g), cells(a, b, h))[0], a, b) for a in range(d) for b in range(a + 1, d)), reverse=True)[:pairs]
    chosen = [(a, b) for _, a, b in found]
    pair_tables = np.zeros((len(chosen), PAIR_BINS, PAIR_BINS))
    for _ in range(rounds // 4):
        for k, (a, b) in enumerate(chosen):
            g, h = slopes()
            step = RATE * four_cells(cells(a, b, g), cells(a, b, h))[1]
            pair_tables[k] += step
            total += step[coarse[:, a], coarse[:, b]]
    return Gam(intercept, cuts, tables, chosen, pair_tables)


def with_features(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, kept columns (as keep_*), x (array of features)."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [features_of(t) for t in texts(batch, "words_text")]
        at = batch.schema.get_field_index("words_text")
        return pa.RecordBatch.from_arrays([c if i != at else pa.array(x, pa.list_(pa.float64())) for i, c in enumerate(batch.columns)], names=[f.name if i != at else "x" for i, f in enumerate(batch.schema)])

    df = docs.select(docs[key].alias("key"), *(docs[c].alias(f"keep_{c}") for c in keep), docs[text].cast("string").alias("words_text"))
    schema = T.StructType([T.StructField("x", T.ArrayType(T.DoubleType())) if f.name == "words_text" else f for f in df.schema])
    return df.mapInArrow(per_slice(rows), schema)


def train(docs: DataFrame, labels: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", label: str = "quality", label_key: str = "doc_id", sample: int = SAMPLE) -> Gam:
    """A model from the documents that have a label and aren't held out (a column over `key`); only the sample's features are made."""
    known = labels.select(labels[label_key].alias("key"), labels[label].cast("int").alias("y")).where("key is not null and y in (0, 1)").distinct()
    rows = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text")).where(~F.coalesce(held_out, F.lit(True)))
    there = rows.select("key").distinct().join(known, "key")  # keys alone; no text is moved
    n = there.count()
    place = F.pmod(F.xxhash64("key", "y"), F.lit(1 << 30))
    chosen = there.where(place < (1 << 30 if n <= sample else int((1 << 30) * 0.95 * sample / n))).limit(sample)  # so it may be broadcast
    found = with_features(rows.join(F.broadcast(chosen), "key"), "key", "text", ("y",)).select("keep_y", "x").limit(2 * sample).collect()
    found.sort(key=lambda r: (r.x, r.keep_y))
    return fit(np.array([r.x for r in found]).reshape(-1, len(FEATURES)), np.array([float(r.keep_y) for r in found]))


def score_quality(docs: DataFrame, labels: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """One row a document: key, held_out, score, predicted. held_out: a column over `key`."""
    model = docs.sparkSession.sparkContext.broadcast(vars(train(docs, labels, held_out, key, text, sample=sample)))  # plain values, as executors need not have this package

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = Gam(**model.value).score(np.array([features_of(t) for t in texts(batch, "words_text")]).reshape(-1, len(FEATURES)))
        return pa.RecordBatch.from_arrays([*(column(batch, c) for c in ("key", "held_out")), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["key", "held_out", "score", "predicted"])

    df = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("words_text"))
    df = df.select("key", F.coalesce(held_out, F.lit(False)).alias("held_out"), "words_text")
    schema = T.StructType([df.schema["key"], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return df.mapInArrow(per_slice(rows), schema).withColumnRenamed("key", key)


def keep_good(docs: DataFrame, labels: DataFrame, held_out: Column, keep: tuple[str, ...], key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents (columns `keep`) that the classifier doesn't reject; each text is scored where it is read."""
    model = docs.sparkSession.sparkContext.broadcast(vars(train(docs, labels, held_out, key, text)))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([features_of(t) for t in texts(batch, "words_text")]).reshape(-1, len(FEATURES))
        kept = batch.filter(pa.array(Gam(**model.value).score(x) >= threshold))
        return kept.drop_columns(["words_text"])

    df = docs.select(*(docs[c].alias(f"keep_{c}") for c in keep), docs[text].cast("string").alias("words_text"))
    kept = df.mapInArrow(per_slice(rows), T.StructType(df.schema.fields[:-1]))
    return kept.select(*(F.col(f"keep_{c}").alias(c) for c in keep))
