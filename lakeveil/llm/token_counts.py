"""Count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists every vocabulary piece that ends at each place of a chunk; dynamic programming keeps
the best score and the piece count of that path. Tie rule of the exact tokenizer: at one end the piece that starts
first wins, and a later start replaces it only with a strictly higher score. A character that is no piece costs the
least score less 10 and counts as its UTF-8 bytes (byte pieces).

The vocabulary file at hand holds merge ranks as whole-number scores; they are read as the unigram scores. No piece
has a space mark after another character or holds a line end, so a text falls apart, without loss, into chunks of
space marks followed by other characters, which repeat and are memorised by each worker. Whole-number scores add up
exactly, so the chunks' sums are the text's.

Null and empty texts have no tokens and score 0; every row gives one row; other columns are left out. The recursion
runs while the automaton reads and holds one piece's length of places, so a very long chunk needs no more memory.
"""

from __future__ import annotations

import re
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import MEMO, column, per_slice, worker_memory

SPACE = "▁"
UNKNOWN_PENALTY = 10
CHUNK = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")


def unigram_vocabulary(model_file: str) -> list[tuple[str, float]]:
    """(piece, score) of the normal pieces of a model file; control, unknown and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return [(model.id_to_piece(i), model.get_score(i)) for i in ids]


class Viterbi:
    """Score and piece count of the best segmentation."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.separable, self.width = True, 2
        least = 0.0
        for piece, score in vocabulary:
            score = int(score) if float(score).is_integer() else score
            least, self.width = min(least, score), max(self.width, len(piece) + 1)
            self.automaton.add_word(piece, (len(piece), score))
            self.separable &= SPACE not in piece.lstrip(SPACE) and "\n" not in piece and isinstance(score, int)
        self.automaton.make_automaton()
        self.unknown = least - UNKNOWN_PENALTY
        self.memo: dict[str, tuple[int, float]] = {}

    def best(self, chunk: str) -> tuple[int, float]:
        """(pieces, score) of a chunk."""
        n, width = len(chunk), self.width
        scores, counts = [0] * width, [0] * width  # of the last places, as many as a piece reaches back
        best, count, single, at = None, 0, False, 1
        for last, found in chain(self.automaton.iter(chunk), ((n, None),)):
            while at <= last:  # all pieces that end at this place are known
                if not single:
                    total = scores[(at - 1) % width] + self.unknown
                    if best is None or total > best:
                        best, count = total, counts[(at - 1) % width] + len(chunk[at - 1].encode())
                scores[at % width], counts[at % width] = best, count
                best, count, single, at = None, 0, False, at + 1
            if found:
                size, score = found  # longest first
                single |= size == 1
                total = scores[(at - size) % width] + score
                if best is None or total > best:
                    best, count = total, counts[(at - size) % width] + 1
        return counts[n % width], scores[n % width]

    def count(self, text: str) -> tuple[int, float]:
        """(pieces, score) of a text, a space mark before it as the tokenizer puts it."""
        if not text:
            return 0, 0.0
        marked = SPACE + text.replace(" ", SPACE)
        if not self.separable:
            return self.best(marked)
        pieces, score = 0, 0
        for chunk in CHUNK.findall(marked):
            own = self.memo.get(chunk)
            if own is None:
                own = self.best(chunk)
                if len(chunk) <= 64:
                    if len(self.memo) >= MEMO:
                        self.memo.clear()
                    self.memo[chunk] = own
            pieces += own[0]
            score += own[1]
        return pieces, float(score)


def count_tokens(docs: DataFrame, vocabulary: list[tuple[str, float]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, n_tokens long, score double of the best segmentation."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # a vocabulary file: bounded, whatever the input
    name = str(shared._jbroadcast.id())

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        memory = worker_memory()
        if memory.get("viterbi_of") != name:
            memory["viterbi_of"], memory["viterbi"] = name, Viterbi(shared.value)
        out = [memory["viterbi"].count(t or "") for t in column(batch, "text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.float64())], names=["key", "n_tokens", "score"])

    df = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
    schema = T.StructType([T.StructField("key", df.schema["key"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("score", T.DoubleType())])
    return df.mapInArrow(per_slice(rows), schema).withColumnRenamed("key", key)
