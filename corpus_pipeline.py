"""A corpus pipeline of five stages, each over all documents that its predecessor kept.

Stages take (spark, docs, sf_dir) and return documents (doc_id, text, lang, source, n_chars), the last one the packed
pieces. Decisions take effect: rejected documents go, repeated lines are cut out of the texts (a document of which
nothing but blank lines is left goes, too), one document of each group of near copies stays, documents that share ten
words or more with the benchmark go.

Nulls may be in any column; columns but the five above are left out, whatever their names, and an empty table gives an
empty result at every stage. Texts are taken whole, however long. Empty and null texts are scored like others, have no
lines, copies or passages, and are packed as the end token alone. Rows that repeat (equal key and text) stay as often
until the n-gram join, which keeps one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeveil.llm import gam, line_dedup, packing, parity_join, winnowing
from lakeveil.llm.queries import fold, table, tokenizer_file
from lakeveil.llm.shared import forget, materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. A null text counts as empty; rows with a null key are scored, not learned from; equal texts fare alike."""
    return gam.keep_good(docs, table(spark, sf_dir, "labels"), fold(F.col("key")) == 0, COLUMNS)


def line_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that match an earlier line; n_chars follows the text.

    Earlier is by key, then place; repeated rows are at one place and keep their lines. Rows with a null key or text stay as they are.
    """
    kept = line_dedup.dedup_lines(docs.select(*COLUMNS))
    kept = kept.where((F.col("n_removed") == 0) | F.col("text").rlike(r"(?U)\S"))
    return kept.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("bigint"))).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group linked by five-word shingles at 0.8 or more.

    A null doc_id is the greatest. Rows of one doc_id and text are one; documents without words link with nothing.
    """
    return parity_join.keep_one(docs, COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Null and empty texts have none; repeated rows and null keys fare by their text alone."""
    return winnowing.decontaminate(docs, table(spark, sf_dir, "benchmark"), COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens. Null texts are empty and make one piece of one token; every row is packed, null keys too."""
    with open(tokenizer_file("word_bpe_49k.json"), encoding="utf-8") as f:
        return packing.pack(docs, f.read())


STAGES = [("quality", quality), ("line_dedup", line_repeats), ("ngram_join", near_copies), ("decontamination", benchmark), ("packing", pack)]

#: The classifier and the tokenizer can't be said in SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage's rows are written to the shared folder and read again, and deleted when the next stage's are there."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = materialize(stage(spark, docs, sf_dir), name)
        forget(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
