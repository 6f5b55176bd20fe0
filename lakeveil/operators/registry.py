"""Placeholders: one name for each value of a type, numbered by first occurrence within a container.

Numbers are given in two steps, so that a container with a large share of all rows isn't one task's work: values are
numbered within ranges of pages, and each range starts where the ranges before it end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import entity_name, folded

#: Pages of a container whose values are numbered together.
RANGE = 4096


def placeholder(entity: Column, number: Column) -> Column:
    return F.format_string("%s_%03d", entity, number)


def assign(values: DataFrame, reserved: DataFrame | None = None) -> DataFrame:
    """(container, entity_type, key, placeholder, original, page_no) of values (container, page_no, start, entity_type, value).

    reserved: (container, placeholder) names that the texts hold already. A clash raises the container's type by a
    mark (TYPE_X) rather than giving a name twice.
    """
    named = values.select("container", F.greatest("page_no", F.lit(0)).cast("bigint").alias("page_no"), "start", entity_name(F.col("entity_type")).alias("entity_type"), "value", folded(F.col("value")).alias("key")).where("key <> ''")
    place = F.struct("page_no", "start")
    first = named.groupBy("container", "entity_type", "key").agg(F.min(place).alias("first"), F.min_by("value", F.struct("page_no", "start", "value")).alias("original"))
    part = first.withColumn("part", F.floor(F.col("first.page_no") / RANGE))
    inside = Window.partitionBy("container", "entity_type", "part").orderBy("first", "key")
    counts = part.groupBy("container", "entity_type", "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("container", "entity_type").orderBy("part")) - F.col("n")).drop("n")
    numbered = part.withColumn("k", F.row_number().over(inside)).join(before, ["container", "entity_type", "part"])
    name = F.col("entity_type")
    if reserved is not None:
        taken = reserved.select("container", F.regexp_extract("placeholder", r"^(.*)_\d+$", 1).alias("entity_type")).distinct().withColumn("taken", F.lit(True))
        numbered = numbered.join(taken, ["container", "entity_type"], "left")
        name = F.when(F.col("taken"), F.concat("entity_type", F.lit("_X"))).otherwise(name)
    number = (F.col("k") + F.col("before")).cast("int")
    return numbered.select("container", "entity_type", "key", placeholder(name, number).alias("placeholder"), "original", F.col("first.page_no").alias("page_no"))


def lookup(values: DataFrame, registry: DataFrame) -> DataFrame:
    """Values with their placeholders."""
    keyed = values.withColumn("entity_type", entity_name(F.col("entity_type"))).withColumn("key", folded(F.col("value")))
    return keyed.join(registry.select("container", "entity_type", "key", "placeholder"), ["container", "entity_type", "key"])
