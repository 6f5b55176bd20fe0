"""Bulk-synchronous best-fit packing of token sequences.

Documents are cut into pieces of at most `capacity` tokens and range-sorted by length, longest first. Each superstep
takes all pieces of the longest length left and matches them with the gaps that are open, also sorted by size: the
successor of a piece is the smallest gap that holds it. Where more pieces than gaps meet, rank decides (pieces by
place within their length, gaps by sequence number); then the gaps are updated and the next step begins. Pieces
without a gap open new sequences.

Lengths are whole numbers up to the capacity, so pieces of one length and gaps of one history are alike and the
sweeps run over runs of them: a run is (first sequence, how many, filled). The plan depends on the counts of the
lengths alone (at most `capacity` of them), and has a row for each match of a run of pieces with a run of gaps. Every
piece then finds its place from its length and its rank, in the executors.

Null texts count as empty: a document of the end token alone. Repeated rows are packed as often as they occur, null
keys too; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import MEMO, column, materialize, per_slice, texts, worker_memory

CAPACITY = 2048
END_ID = 0


# How a tokenizer file must normalise and part texts for its words to be encoded one by one.
NORMALIZERS = ("NFC", "Replace", "Lowercase")
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def parts_words(tokenizer_json: str) -> bool:
    """Whether the file lower-cases, parts texts at white space and between letters and punctuation, and then works on bytes."""
    file = json.loads(tokenizer_json)
    steps = (file.get("normalizer") or {}).get("normalizers") or [{}]
    parts = (file.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    return (
        tuple(x.get("type") for x in steps) == NORMALIZERS and (steps[1].get("pattern"), steps[1].get("content")) == ({"Regex": r"\s+"}, " ")
        and [x.get("type") for x in parts] == ["Split", "ByteLevel"] and parts[0].get("pattern") == {"Regex": SPLIT} and bool(parts[0].get("invert"))
        and not parts[1].get("use_regex") and not parts[1].get("add_prefix_space")
    )


def byte_letters() -> dict[int, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others are numbered from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in own]
    return {b: 256 + i for i, b in enumerate(others)}


class WordIds:
    """Token ids (little-endian 32-bit) of texts (UTF-8), word by word.

    A tokenizer that parts texts at white space, and between letters and punctuation, before anything else never joins
    over such a place. So the ids of the stretches between white space, A-Z lower-cased, are the ids of the text; of a
    word with punctuation (no apostrophe) behind its last letter, the ids of both parts. Words of lower-case Latin
    letters alone need no normalising and go to the merges straight away, written in byte letters. Each worker
    memorises words in two generations: when the young one is full it becomes the old one, and words that are met
    again come back. Texts that might hold a special token, and all texts of a file that parts them otherwise, are
    encoded whole.
    """

    #: Lower-case letters of Latin-1 in UTF-8; a word that ends in one; ASCII punctuation but the apostrophe.
    LETTERS = re.compile(rb"(?:[a-z]|\xC3[\x9F-\xB6\xB8-\xBF])+")
    TAIL = re.compile(rb"(.*(?:[a-z]|\xC3[\x9F-\xB6\xB8-\xBF]))([!-&(-/:-@\[-`{-~]+)", re.S)

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.by_word = parts_words(tokenizer_json)
        self.merges, self.letters = self.tokenizer.model, byte_letters()
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def exact(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def merged(self, word: bytes) -> bytes:
        """Ids of a word of letters."""
        written = word.decode() if word.isascii() else word.decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.merges.tokenize(written)]).tobytes()

    def learn(self, words: set[bytes]) -> None:
        """Put words into the young generation."""
        if len(self.young) > MEMO:
            self.old, self.young = self.young, {}
        young, old, parts, todo = self.young, self.old, {}, set()
        is_letters, tail = self.LETTERS.fullmatch, self.TAIL.fullmatch

        def known(w: bytes) -> bool:
            """From memory or by the merges."""
            if w in young:
                return True
            if (ids := old.get(w)) is None and is_letters(w):
                ids = self.merged(w)
            if ids is not None:
                young[w] = ids
            return ids is not None

        for w in words.difference(young):
            if not known(w):
                if m := tail(w):
                    parts[w] = both = m.groups()
                    todo.update(x for x in both if not known(x))
                else:
                    todo.add(w)
        young.update(zip(todo, self.exact([w.decode() for w in todo])))
        for w, (head, tail_) in parts.items():
            young[w] = young[head] + young[tail_]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        split = [t.lower().split() if self.by_word and b"<|" not in t else None for t in texts]
        self.learn(set().union(*filter(None, split)))
        get = self.young.__getitem__
        return [self.exact([t.decode()])[0] if words is None else b"".join(map(get, words)) for t, words in zip(texts, split)]


def tokenize(docs: DataFrame, tokenizer_json: str, capacity: int = CAPACITY, end_id: int = END_ID, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row a piece: key, piece, start, length, ids_crc32, the task and the piece's rank among that task's pieces of its length; ids on request."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # a vocabulary file: bounded, whatever the input
    name = str(shared._jbroadcast.id())
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        ranks: dict[int, int] = defaultdict(int)
        task = TaskContext.get().partitionId()
        memory = worker_memory()
        if memory.get("word_ids_of") != name:
            memory["word_ids_of"], memory["word_ids"] = name, WordIds(shared.value)

        def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: dict[str, list] = {k: [] for k in ("piece", "start", "length", "ids_crc32", "task", "task_rank")}
            at, parts = [], []
            for i, ids in enumerate(memory["word_ids"].encode(texts(batch))):
                ids += end
                for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[start : start + 4 * capacity]
                    n = len(part) // 4
                    for k, v in zip(out, (piece, start // 4, n, zlib.crc32(part), task, ranks[n])):
                        out[k].append(v)
                    ranks[n] += 1
                    at.append(i)
                    if with_ids:
                        parts.append(np.frombuffer(part, "<u4").astype(np.int32))
            arrays = [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(v, pa.int64()) for v in out.values())]
            return pa.RecordBatch.from_arrays(arrays + [pa.array(parts, pa.list_(pa.int32()))] * with_ids, names=["key", *out, *["ids"] * with_ids])

        yield from per_slice(rows)(batches)

    df = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
    schema = T.StructType([T.StructField("key", df.schema["key"].dataType), *(T.StructField(k, T.LongType()) for k in ("piece", "start", "length", "ids_crc32", "task", "task_rank"))])
    if with_ids:
        schema.add("ids", T.ArrayType(T.IntegerType()))
    return df.mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset, how many), sorted: the matches of all supersteps."""
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # size -> runs (first sequence, how many)
    matches: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def put(length: int, rank: int, size: int, run: tuple[int, int], n: int) -> None:
        matches.append((length, rank, run[0], capacity - size, n))
        if size - length:
            gaps[size - length].append((run[0], n))
        if run[1] > n:
            gaps[size].append((run[0] + n, run[1] - n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            size = min((g for g, runs in gaps.items() if g >= length and runs), default=None)
            if size is None:  # new sequences, each for as many of these pieces as it holds
                gaps[capacity].append((opened, new := -(-left // (capacity // length))))
                opened += new
                size = capacity
            run = gaps[size].pop()
            n = min(left, run[1])
            put(length, rank, size, run, n)
            rank, left = rank + n, left - n
    return np.array(sorted(matches), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer_json: str, capacity: int = CAPACITY, end_id: int = END_ID, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row a piece: key, piece, start, length, ids_crc32, sequence_id, offset; ids on request."""
    pieces = materialize(tokenize(docs, tokenizer_json, capacity, end_id, key, text, with_ids), "pieces")
    by_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    first = by_task.select("task", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("first"))
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    table = docs.sparkSession.sparkContext.broadcast(plan(counts, capacity))  # depends on the capacity, not on the input's size
    kept = [c for c in pieces.columns if c not in ("task", "task_rank")]

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        t = table.value
        length, rank = (column(batch, c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
        span = np.int64(1) << 40
        at = np.searchsorted(t[:, 0] * span + t[:, 1], length * span + rank, side="right") - 1
        placed = {"sequence_id": t[at, 2] + rank - t[at, 1], "offset": t[at, 3]}
        return pa.RecordBatch.from_arrays([*(column(batch, c) for c in kept), *map(pa.array, placed.values())], names=[*kept, *placed])

    ranked = pieces.join(first, ["task", "length"]).withColumn("rank", F.col("first") + F.col("task_rank")).select(*kept, "rank")
    schema = T.StructType([*(pieces.schema[c] for c in kept), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(per_slice(rows, 65_536), schema).withColumnRenamed("key", key)
