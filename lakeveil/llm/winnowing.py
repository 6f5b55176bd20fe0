"""Benchmark decontamination by winnowing.

Both sides keep the least k-gram hash of every sliding window of k-grams (with ties, each place that holds it). With
k = 5 and 6 k-grams a window, any 10 shared words have a fingerprint in common. Fingerprints that meet are extended
word by word to the longest shared run; a run of 10 words or more is a hit. An item of fewer words is one window of
its own length and is compared at every place.

The benchmark's words, fingerprints and places are broadcast in blocks of at most BLOCK_WORDS words; a benchmark
beyond one block is worked off block by block, each pass adding to the hits of the one before.

Null, empty and blank texts have no words and no hits; items without words match nothing; every document row gives
one row, repeated rows too; an item_id that occurs twice counts once; rows with a null item_id take no part.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import column, forget, materialize, per_slice, texts, worker_memory

WINDOW = 10
K = 5
#: Words of the benchmark in one broadcast; a block holds whole items.
BLOCK_WORDS = 400_000

#: Lower-cases A-Z; every other ASCII character but letters and digits parts words.
WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


def gram_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = (h * np.uint64(0x100000001B3)) ^ (ids[i : i + n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        h ^= h >> np.uint64(29)
    return h


def fingerprints(h: np.ndarray, width: int) -> np.ndarray:
    """Places of the least hashes of all windows of `width` k-grams."""
    if len(h) < width:
        return np.zeros(0, np.int64)
    low = np.lib.stride_tricks.sliding_window_view(h, width).min(axis=1)
    keep = np.zeros(len(h), bool)
    for i in range(width):
        keep[i : i + len(low)] |= h[i : i + len(low)] == low
    return np.flatnonzero(keep)


class Items:
    """A block of the benchmark, ready for documents."""

    def __init__(self, items: list[tuple], window: int = WINDOW, k: int = K):
        self.window, self.k, self.width = window, k, window - k + 1
        self.vocabulary: dict[bytes, int] = {}
        self.ids, self.words = [], []
        self.prints: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.short: dict[int, dict[tuple, set[int]]] = defaultdict(lambda: defaultdict(set))
        for key, text in items:
            found = words_of(text or b"")
            if not found:
                continue
            at = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found], np.int64)
            n = len(self.ids)
            self.ids.append(key)
            self.words.append(at)
            if len(at) < window:
                self.short[len(at)][tuple(at.tolist())].add(n)
            else:
                h = gram_hashes(at, k)
                for p in fingerprints(h, self.width).tolist():
                    self.prints[int(h[p])].append((n, p))
        self.hashes = np.array(sorted(self.prints), np.uint64)

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Ranges of words inside occurring windows, and the items."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        ranges, items = [], set()
        if not ids.any():
            return ranges, items
        for m, known in self.short.items():
            if len(ids) >= m:
                view = np.lib.stride_tricks.sliding_window_view(ids, m)
                first = np.fromiter({t[0] for t in known}, np.int64)
                for p in np.flatnonzero(np.isin(ids[: len(ids) - m + 1], first)).tolist():
                    if own := known.get(tuple(view[p].tolist())):
                        ranges.append((p, p + m))
                        items |= own
        if len(self.hashes) and len(ids) >= self.window:
            unknown = np.flatnonzero(ids == 0)
            if np.diff(unknown, prepend=-1, append=len(ids)).max() > self.window:  # else no run of known words is long enough
                h = gram_hashes(ids, self.k)
                places = fingerprints(h, self.width)
                at = np.minimum(np.searchsorted(self.hashes, h[places]), len(self.hashes) - 1)
                places = places[self.hashes[at] == h[places]]
                over: dict[tuple[int, int], int] = {}
                for p in places.tolist():
                    for n, q in self.prints[int(h[p])]:
                        if over.get((n, p - q), -1) > p:
                            continue  # inside a run that is known
                        a, b = self.extended(ids, self.words[n], p, q)
                        over[n, p - q] = b
                        if b - a >= self.window:
                            ranges.append((a, b))
                            items.add(n)
        return ranges, items

    def extended(self, doc: np.ndarray, item: np.ndarray, p: int, q: int) -> tuple[int, int]:
        """The longest run that both share along one diagonal around a place."""
        left, right = min(p, q), min(len(doc) - p, len(item) - q)
        same = doc[p - left : p + right] == item[q - left : q + right]
        off = np.flatnonzero(~same)
        before, after = off[off < left], off[off >= left]
        return p - left + (int(before[-1]) + 1 if len(before) else 0), p - left + (int(after[0]) if len(after) else left + right)


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def blocks(benchmark: DataFrame, item: str, text: str, most: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in order, in blocks of at most `most` words (or one longer item)."""
    rows = benchmark.select(benchmark[item].cast("string").alias("item"), benchmark[text].cast("string").alias("text")).where("item is not null").distinct()
    block, n = [], 0
    for r in rows.toLocalIterator():
        own = (r.item, (r.text or "").encode())
        w = len(words_of(own[1]))
        if block and n + w > most:
            yield block
            block, n = [], 0
        block.append(own)
        n += w
    if block:
        yield block


def find_overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
                  window: int = WINDOW, k: int = K, block_words: int = BLOCK_WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: key, kept columns, n_words, hits (array of start, end in words), items (ids as sorted strings)."""
    if k > window:
        raise ValueError("k is larger than the window")
    spark = docs.sparkSession
    df = docs.select(docs[key].alias("key"), *(docs[c].alias(f"keep_{c}") for c in keep), docs[text].cast("string").alias("words_text"))
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    df = df.withColumns({"n_words": F.lit(None).cast("bigint"), "hits": F.lit(None).cast(span), "items": F.lit(None).cast("array<string>")})
    schema, old = df.schema, None
    every = blocks(benchmark, item, item_text, block_words)
    block = next(every, [])
    while block is not None:
        following = next(every, None)
        df = df.mapInArrow(per_slice(block_rows(spark.sparkContext.broadcast(block), window, k)), schema)
        if following is not None:
            df = materialize(df, "overlaps")
            if old is not None:
                forget(old)
            old = df
        block = following
    return df.select(F.col("key").alias(key), *(F.col(f"keep_{c}").alias(c) for c in keep), "n_words", "hits", "items")


def block_rows(block, window: int, k: int):
    name = (str(block._jbroadcast.id()), window, k)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        memory = worker_memory()
        if memory.get("items_of") != name:
            memory["items_of"], memory["items"] = name, Items(block.value, window, k)
        items = memory["items"]
        n_words, hits, found = [], [], []
        for t, was, own in zip(texts(batch, "words_text"), column(batch, "hits").to_pylist(), column(batch, "items").to_pylist()):
            words = words_of(t)
            ranges, got = items.hits(words)
            ranges += [(r["start"], r["end"]) for r in was or []]
            n_words.append(len(words))
            hits.append([{"start": a, "end": b} for a, b in merged(ranges)])
            found.append(sorted({*(own or []), *(items.ids[n] for n in got)}))
        new = {"n_words": n_words, "hits": hits, "items": found}
        return pa.RecordBatch.from_arrays([pa.array(new[f.name], f.type) if f.name in new else batch.column(i) for i, f in enumerate(batch.schema)], schema=batch.schema)

    return rows


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def decontaminate(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...], key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents (columns `keep`) of which no word lies in a shared window."""
    return find_overlaps(docs, benchmark, key, text, keep=tuple(c for c in keep if c != key)).where(F.size("hits") == 0).select(*keep)
