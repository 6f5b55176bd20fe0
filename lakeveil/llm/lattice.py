"""LM scoring with subword lattices.

A word's lattice holds every segmentation of it (a space mark before it) into vocabulary pieces, and, if the training
texts have the word, one arc over all of it. A forward recursion in log space sums over all paths:

    P(token) = (c + a * L(token)) / (N + a)

c is the token's count in the training texts, N their tokens, so c / (N + a) is the weight of the whole word's arc; a,
the number of words seen once there, is the mass that new words deserve, and L is the sum over all segmentations into
pieces. The pieces of a text's words never reach over a space, so the text's marginal probability is the product of
its words', and of the end token's.

The pieces' weights start from the vocabulary's scores and are learned from all distinct words of the training texts
by expected counts (ROUNDS times): each round weighs every segmentation by the last weights, adds up how often each
piece is expected, and PRIOR such counts come from the vocabulary's scores. The file at hand has merge ranks as scores
(score = -rank), so a score s starts as 1 / (10 - s). Characters that are no piece weigh what is learned for them,
spread over byte values; a piece ends its word with the learned probability `stop`. Sums of expected counts are equal
from run to run up to the rounding of doubles.

Word statistics cover all training texts. They grow with the input and stay distributed: only words with at least
N / HOT occurrences (so HOT words at most) are broadcast; the others' rows meet their counts in a join by word. The
expected counts are one number a piece, as many as the vocabulary has. Words of SHORT characters or fewer are summed up
in plain numbers, others, and those whose sums are too small for that, in logarithms; both give the same sums.

Null, empty and blank texts consist of the end token; a null key counts as training; every row gives one row,
repeated rows too; other columns are left out; an empty table gives an empty result. A very long word is read by the
forward recursion piece by piece, in memory for one piece's length; for learning alone it is parted every STRETCH
characters.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import column, forget, materialize, per_slice, texts, worker_memory

HOT = 131_072
STOP = 0.3
UNKNOWN = 1e-3
END_SHARE = 0.01
#: Rounds of expected counts, and counts that the vocabulary's scores are worth in each.
ROUNDS = 2
PRIOR = 10_000.0
#: Characters of a word that are held at a time to learn from it.
STRETCH = 4096
#: Characters up to which a word is summed up in plain numbers, and the least sum for which that is precise.
SHORT, LEAST_SUM = 48, 1e-200
#: Distinct words that a worker gathers before it hands counts on.
GATHER = 250_000
#: The end token; no word is empty.
END = b""
SPACE = "▁"
#: What expected counts are kept of besides the pieces, which have their places in the vocabulary as numbers.
NO_PIECE, WORDS = -1, -2


class Weights(NamedTuple):
    pieces: list[tuple[str, float]]  # logarithms; with `unknown`, the shares sum to 1
    unknown: float = UNKNOWN
    stop: float = STOP


def piece_weights(vocabulary: list[tuple[str, float]]) -> Weights:
    """The weights that the vocabulary's scores give."""
    weights = [(p, 1 / (10 - s)) for p, s in vocabulary if s <= 0]
    total = sum(w for _, w in weights)
    return Weights([(p, math.log((1 - UNKNOWN) * w / total)) for p, w in weights])


def learned(prior: Weights, found: dict[int, float]) -> Weights:
    """Weights by expected counts of the pieces, of characters that are none, and of words."""
    total = sum(n for k, n in found.items() if k != WORDS) + PRIOR

    def share(k: int, before: float) -> float:
        return (found.get(k, 0.0) + PRIOR * before) / total

    return Weights([(p, math.log(share(i, math.exp(w)))) for i, (p, w) in enumerate(prior.pieces)], share(NO_PIECE, prior.unknown), share(WORDS, prior.stop))


def log_sum(logs: list[float]) -> float:
    if len(logs) == 1:
        return logs[0]
    top = max(logs)
    return top + math.log(sum([math.exp(x - top) for x in logs]))


class Lattice:
    def __init__(self, weights: Weights):
        import ahocorasick

        self.automaton, self.width, self.plain = ahocorasick.Automaton(), 2, ahocorasick.Automaton()
        self.single = {piece for piece, _ in weights.pieces if len(piece) == 1}
        go_on = math.log1p(-weights.stop)
        for i, (piece, w) in enumerate(weights.pieces):
            self.automaton.add_word(piece, (len(piece), w + go_on, i))
            self.plain.add_word(piece, (len(piece), math.exp(w + go_on), i))
            self.width = max(self.width, len(piece) + 1)
        self.automaton.make_automaton()
        self.plain.make_automaton()
        self.unknown, self.end = math.log(weights.unknown) + go_on, math.log(weights.stop) - go_on + math.log(1 - END_SHARE)

    def arcs(self, text: str) -> Iterator[list[tuple[int, float, int]]]:
        """For each place of the text, one after the other, the arcs (size, log weight, piece) that end there."""
        here: list[tuple[int, float, int]] = []
        at = 1
        for last, arc in chain(self.automaton.iter(text), ((len(text), None),)):
            while at <= last:
                if not here or here[-1][0] > 1:  # the automaton names the longest first
                    here.append((1, self.unknown - 8 * len(text[at - 1].encode()) * 0.6931471805599453, NO_PIECE))
                yield here
                here, at = [], at + 1
            if arc:
                here.append(arc)

    def sums(self, text: str) -> tuple[list[tuple[int, tuple[int, float, int]]], list[float]] | None:
        """All arcs (last place, (size, weight, piece)) by their ends, and the sums over the paths to each place; None where logarithms are needed: for long texts, characters that are no piece, and very small sums."""
        if len(text) > SHORT or not self.single.issuperset(text):
            return None
        arcs, forward = list(self.plain.iter(text)), [1.0] + [0.0] * len(text)
        for last, (size, w, _) in arcs:
            forward[last + 1] += forward[last + 1 - size] * w
        return (arcs, forward) if forward[-1] > LEAST_SUM else None

    def log_marginal(self, word: str) -> float:
        """Natural logarithm of the sum over all segmentations; the end token's share for no word."""
        if not word:
            return math.log(END_SHARE)
        if short := self.sums(SPACE + word):
            return math.log(short[1][-1]) + self.end
        ring, width, at = [0.0] * self.width, self.width, 0
        for at, arcs in enumerate(self.arcs(SPACE + word), 1):
            ring[at % width] = log_sum([ring[(at - size) % width] + w for size, w, _ in arcs])
        return ring[at % width] + self.end

    def expect(self, word: str, found: dict[int, float]) -> None:
        """Add how often each piece is expected in the word's segmentations."""
        text = SPACE + word
        found[WORDS] += 1
        if short := self.sums(text):
            arcs, forward = short
            backward = [0.0] * len(text) + [1 / forward[-1]]
            for last, (size, w, piece) in reversed(arcs):
                if own := backward[last + 1] * w:
                    backward[last + 1 - size] += own
                    found[piece] += own * forward[last + 1 - size]
            return
        for start in range(0, len(text), STRETCH):
            lattice, forward = list(self.arcs(text[start : start + STRETCH])), [0.0]
            for at, arcs in enumerate(lattice, 1):
                forward.append(log_sum([forward[at - size] + w for size, w, _ in arcs]))
            share = [0.0] * len(lattice) + [1.0]  # of the paths, by place
            for at in range(len(lattice), 0, -1):
                if share[at] > 0:
                    for size, w, piece in lattice[at - 1]:
                        own = share[at] * math.exp(forward[at - size] + w - forward[at])
                        found[piece] += own
                        share[at - size] += own


def in_workers(spark: SparkSession, weights: Weights) -> Callable[[], Lattice]:
    """The lattice, built once a worker."""
    shared = spark.sparkContext.broadcast(tuple(weights))  # a vocabulary file: bounded, whatever the input; plain values, as executors need not have this package
    name = str(shared._jbroadcast.id())

    def get() -> Lattice:
        memory = worker_memory()
        if memory.get("lattice_of") != name:
            memory["lattice_of"], memory["lattice"] = name, Lattice(Weights(*shared.value))
        return memory["lattice"]

    return get


def learn(words: DataFrame, vocabulary: list[tuple[str, float]], rounds: int = ROUNDS) -> Weights:
    """Weights from the distinct words with a count (word, c) of the training texts."""
    prior = weights = piece_weights(vocabulary)
    for _ in range(rounds):
        lattice = in_workers(words.sparkSession, weights)

        def run(batches):
            model, found = lattice(), defaultdict(float)
            for batch in batches:
                for at in range(0, batch.num_rows, 8192):
                    for w in column(batch.slice(at, 8192), "word").to_pylist():
                        model.expect(w.decode(), found)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.float64())], names=["piece", "n"])

        seen = words.where((F.col("c") > 0) & (F.octet_length("word") > 0)).select("word")
        sums = seen.mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()  # a row a piece
        weights = learned(prior, {r.piece: r.n for r in sums})
    return weights


def words_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased, parted at space, tab and line ends; then the end token."""
    words = text.lower().split()
    words.append(END)
    return words


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c): every word of all texts with its count in the training texts. docs: text, held_out."""

    def run(batches):
        counts: Counter = Counter()

        def out():
            rows = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return rows

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for text, held in zip(texts(part), column(part, "held_out").to_pylist()):
                    if held:
                        for w in words_of(text):
                            counts.setdefault(w, 0)
                    else:
                        counts.update(words_of(text))
                if len(counts) > GATHER:
                    yield out()
        if counts:
            yield out()

    rows = docs.select("text", "held_out").mapInArrow(run, "word binary, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("c"))


def score_texts(docs: DataFrame, vocabulary: list[tuple[str, float]], held_out: Column, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """One row a document: key, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10)."""
    spark = docs.sparkSession
    df = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    words = materialize(count_words(df), "words")
    lattice = in_workers(spark, learn(words, vocabulary))

    def with_lattice(batch: pa.RecordBatch) -> pa.RecordBatch:
        logs = [lattice().log_marginal(w.decode()) for w in column(batch, "word").to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(logs, pa.float64())], names=["word", "c", "lattice"])

    counted = materialize(words.mapInArrow(per_slice(with_lattice, 8192), "word binary, c bigint, lattice double"), "lattice")
    forget(words)
    total = counted.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.count_if(F.col("c") == 1).alias("once")).first()
    n, v, mass = total.n, total.v, max(1, total.once)
    base_n, all_n = math.log10(n + 0.5 * (v + 1)), math.log10(n + mass)

    least = max(1, -(-n // hot))
    frequent = counted.where(F.col("c") >= least).collect()  # at most `hot` words, as their counts sum to n at most
    table = spark.sparkContext.broadcast({bytes(r.word): (math.log10(r.c + 0.5) - base_n, math.log10(r.c + mass * math.exp(r.lattice)) - all_n) for r in frequent})

    def run(batches):
        known, task, row = table.value, TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: dict[str, list] = {k: [] for k in ("word", "row", "n", "n_tokens", "n_known", "base", "score")}
                keys, held = [], []
                for i, text in enumerate(texts(part)):
                    words, base, score, n_known = words_of(text), 0.0, 0.0, 0
                    own = task << 40 | row
                    row += 1
                    for w, k in Counter(words).items():
                        found = known.get(w)
                        if found:
                            base += k * found[0]
                            score += k * found[1]
                            n_known += k
                        else:
                            rows["word"].append(w)
                            rows["row"].append(own)
                            rows["n"].append(k)
                    rest = len(rows["word"]) - len(rows["base"])
                    for c in ("n_tokens", "n_known", "base", "score"):
                        rows[c] += [None] * rest
                    keys += [None] * rest
                    held += [None] * rest
                    # the document's own row; its word has a space and so is nobody's
                    for c, x in zip(rows, (b" %d" % own, own, None, len(words), n_known, base, score)):
                        rows[c].append(x)
                    keys.append(i)
                    held.append(i)
                take = pa.array(keys, pa.int64())
                kinds = {"word": pa.binary(), "base": pa.float64(), "score": pa.float64()}
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x, kinds.get(c, pa.int64())) for c, x in rows.items()), column(part, "key").take(take), column(part, "held_out").take(take)],
                    names=[*rows, "key", "held_out"],
                )

    schema = T.StructType([
        T.StructField("word", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in ("row", "n", "n_tokens", "n_known")),
        T.StructField("base", T.DoubleType()), T.StructField("score", T.DoubleType()),
        T.StructField("key", df.schema["key"].dataType), T.StructField("held_out", T.BooleanType()),
    ])
    rows = df.mapInArrow(run, schema).join(counted, "word", "left")
    c, smooth = F.col("c"), F.log10(F.lit(float(mass))) + F.col("lattice") / math.log(10)
    of_word = F.when(c > 0, F.log10(c + F.lit(float(mass)) * F.exp("lattice"))).otherwise(smooth) - all_n
    return (
        rows.groupBy("row")
        .agg(
            F.max("key").alias(key), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
            F.sum(F.coalesce("n_known", F.when(c > 0, F.col("n")), F.lit(0))).alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"),
            F.sum(F.coalesce("base", F.col("n") * (F.log10(c + 0.5) - base_n))).alias("base_score"),
            F.sum(F.coalesce("score", F.col("n") * of_word)).alias("score"),
        )
        .drop("row")
    )
