"""Exact top-k search with MaxScore over sharded postings.

A dimension is a term; a shard's postings of it are the column of its rows' whole-number values, with the least and
greatest of them as score bounds. For a query, terms are ordered by how far their contribution can vary in the shard.
The longest tail whose joint bound cannot lift a row to the k-th best score found so far is non-essential: its terms
are not traversed. The essential terms are traversed for all rows; the rows that could still reach the threshold are
probed in the other terms, the strongest first, and dropped as soon as they no longer compete. The shards' best rows
are merged by rank. Vectors are dense, so the first traversal sees every row of a shard; what is saved is the rest.

Queries and candidates meet in blocks (QUERIES x ROWS), each one task's work, whatever the number of either.

Vectors null, or with null or non-finite components, take no part, nor do null keys. A shorter vector has zeros in
the missing places. Rows with one key are rows of their own: each is a candidate, and the results of queries with one
key are ranked together; a query never meets rows of its own key. Scores beyond 64 bits are cut to the largest 64-bit
number of their sign. Ties go to the smaller key. Other columns are left out. Empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


QUERIES = 2048
ROWS = 8192
#: Rows of a shard that are looked at before the threshold is set anew.
STEP = 2048
#: Terms probed at a time.
PROBE = 16


def whole_vectors(vectors: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """(key, x, row): floor(scale * component) of the vectors that take part, and a number for each row."""
    df = vectors.select(vectors[key].cast("bigint").alias("key"), vectors[vector].cast("array<double>").alias("v"), F.monotonically_increasing_id().alias("row"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    df = df.where(F.col("key").isNotNull() & F.col("v").isNotNull() & fine)
    return df.select("key", F.transform("v", lambda x: F.floor(x * scale)).alias("x"), "row")


def matrix(table: pa.Table, width: int) -> np.ndarray:
    """Rows of whole numbers, padded with zeros."""
    lists = table.column("x").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def exact_type(q: np.ndarray, x: np.ndarray) -> type:
    """A type in which inner products are exact."""
    most = max(abs(int(q.max(initial=0))), abs(int(q.min(initial=0)))) * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * max(1, q.shape[-1])
    return np.float64 if most < 2**53 else np.int64 if most < 2**62 else object


def search(q: np.ndarray, own: int, x: np.ndarray, keys: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(key, score) of one query's k best rows of a shard, whose terms lie between low and high."""
    ends = np.stack([q * low, q * high])
    bound, spread = ends.max(axis=0), ends.max(axis=0) - ends.min(axis=0)
    order = np.argsort(-spread.astype(float), kind="stable")
    rest = np.append(np.cumsum(bound[order][::-1])[::-1], 0)  # what the terms from a place on can add at most
    best: list[tuple[int, int]] = []  # (-score, key)
    for a in range(0, len(x), STEP):
        rows = np.flatnonzero(keys[a : a + STEP] != own) + a
        score = np.zeros(len(rows), x.dtype)
        at = 0
        while at < len(order) and len(rows):
            if at == 0 and len(best) == k:  # essential: terms before the longest tail that cannot reach the threshold alone
                tail = np.flatnonzero(rest[1:] < -best[-1][0])
                stop = int(tail[0]) + 1 if len(tail) else len(order)
            else:
                stop = min(len(order), at + PROBE)
            terms = order[at:stop]
            score = score + x[np.ix_(rows, terms)] @ q[terms]
            at = stop
            if len(best) == k and at < len(order):
                alive = score + rest[at] >= -best[-1][0]
                rows, score = rows[alive], score[alive]
        if len(rows) > 4 * k:
            edge = np.partition(score, len(score) - k)[len(score) - k] if x.dtype != object else sorted(score)[-k]
            rows, score = rows[score >= edge], score[score >= edge]
        best = sorted([*best, *((-int(s), int(keys[r])) for r, s in zip(rows, score))])[:k]
    return [(key, -s) for s, key in best]


def top_k(vectors: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding", scale: float = 1.0, queries_a_block: int = QUERIES, rows_a_block: int = ROWS) -> DataFrame:
    """query_id, rank (from 1), the key and score of each query's k highest scores. is_query: a column over `key`."""
    whole = whole_vectors(vectors, key, vector, scale)
    size = whole.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q"), F.coalesce(F.max(F.size("x")), F.lit(0)).alias("width")).first()
    shards, blocks, width = max(1, -(-size.n // rows_a_block)), max(1, -(-size.q // queries_a_block)), size.width
    queries = whole.where(is_query).select("key", "x", F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))).alias("shard"))
    rows = whole.select("key", "x", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block"), F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"))

    def meet(q: pa.Table, x: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "key": [], "score": []}
        if q.num_rows and x.num_rows:
            qs, xs = matrix(q, width), matrix(x, width)
            kind = exact_type(qs, xs)
            qs, xs = qs.astype(kind), np.asfortranarray(xs.astype(kind))
            low, high, keys = xs.min(axis=0), xs.max(axis=0), column_of(x, "key")
            for own, v in zip(column_of(q, "key").tolist(), qs):
                for found, score in search(v, own, xs, keys, low, high, k):
                    out["query_id"].append(own)
                    out["key"].append(found)
                    out["score"].append(max(-(2**63), min(2**63 - 1, score)))
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    def column_of(t: pa.Table, name: str) -> np.ndarray:
        return t.column(name).to_numpy()

    met = queries.groupBy("block", "shard").cogroup(rows.groupBy("block", "shard")).applyInArrow(meet, "query_id bigint, key bigint, score bigint")
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", F.col("key").alias(key), "score")
