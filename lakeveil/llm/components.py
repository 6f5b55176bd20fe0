"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import forget, materialize


def pair(u: Column, v: Column) -> Column:
    return F.struct(u.alias("u"), v.alias("v"))


def least_of(edges: DataFrame) -> DataFrame:
    """Edges with m, the least neighbour of u; a node's neighbours stream through a window that can spill."""
    return edges.withColumn("m", F.min("v").over(Window.partitionBy("u")))


def one_round(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours to the least of them and it, then every node's smaller ones. Edges: u > v."""
    both = edges.select(F.explode(F.array(pair(F.col("u"), F.col("v")), pair(F.col("v"), F.col("u")))).alias("e")).select("e.*")
    large = least_of(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
    small = least_of(large).select(F.explode(F.array(pair(F.col("v"), F.col("m")), pair(F.col("u"), F.col("m")))).alias("e")).select("e.*")
    return small.where("u <> v").distinct()


def all_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a lesser node that has none: then that is its component."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e"))
    nodes = ends.select("e.*").groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.agg(F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).alias("n")).first().n == 0


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable, for every node with an edge to another. edges: u, v, of one type.

    Every round joins each node's neighbours to their least one; the table is written after every round, and stays
    distributed. Null ends and loops count nothing.
    """
    some = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = materialize(one_round(some), "edges")
    for _ in range(rounds):
        if all_stars(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        new = materialize(one_round(now), "edges")
        forget(now)
        now = new
    raise RuntimeError("components did not converge")
