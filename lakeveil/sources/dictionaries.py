"""Block and allow dictionaries: one term a line, trimmed and lower-cased, terms of up to two characters dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed import SHORTEST_TERM
from ..functions.text import strip
from .pages import exists


def terms(lines: DataFrame, line: str = "value") -> DataFrame:
    term = F.lower(strip(F.col(line)))
    return lines.select(term.alias("term")).where(F.length("term") >= SHORTEST_TERM).distinct()


def load(spark: SparkSession, path: str) -> DataFrame:
    """The terms of a file; none if there is no such file."""
    if not exists(spark, path):
        return spark.createDataFrame([], "term string")
    return terms(spark.read.text(path))


def save(found: DataFrame, path: str) -> None:
    """One sorted file; terms are written as they are, short ones too."""
    found.select("term").distinct().orderBy("term").coalesce(1).write.mode("overwrite").text(path)


def as_lines(found: DataFrame) -> DataFrame:
    return found.groupBy().agg(F.array_join(F.sort_array(F.collect_set("term")), "\n").alias("content"))


def move(terms_to: DataFrame, terms_from: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Put new terms into one dictionary and take them out of the other."""
    new = new.where(F.length("term") >= SHORTEST_TERM).select("term").distinct()
    return terms_to.select("term").union(new).distinct(), terms_from.select("term").join(new, "term", "left_anti")


def conflicts(block: DataFrame, allow: DataFrame) -> DataFrame:
    """Terms that are in both."""
    return block.select("term").intersect(allow.select("term"))
