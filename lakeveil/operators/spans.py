"""Occurrences of terms, protection by the allow dictionary, and suppression of overlaps.

Candidates are rows (container, page_no, priority, term, entity_type, start, end). Priority: 0 what is already
marked, 1 images, 2 block dictionary, 3 detections.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import IMAGE_LABEL
from ..functions.boxes import overlap
from ..functions.text import literal, matches

#: Terms of a dictionary in one broadcast.
TERMS = 10_000
EXISTING, IMAGE, BLOCK, DETECTION = range(4)
PAGE = ("container", "page_no")


def occurrences(pages: DataFrame, terms: DataFrame, on_page: bool = False, whole_word: bool = False, as_written: bool = False) -> DataFrame:
    """Every place where a term occurs in a page's text, in either case. terms: term and columns that go along.

    on_page: terms have the container and page that they are looked for on, and are joined by it. Otherwise a
    dictionary meets all pages: it is broadcast in blocks of about TERMS terms, one block if it is no larger.
    as_written: the term is given as the page spells it.
    """
    pages = pages.select(*PAGE, "text")
    if on_page:
        both = pages.join(terms, list(PAGE))
    else:
        n = -(-terms.count() // TERMS) or 1
        blocks = (terms.where(F.pmod(F.xxhash64("term"), F.lit(n)) == i) if n > 1 else terms for i in range(n))
        both = reduce(DataFrame.unionByName, (pages.join(F.broadcast(b), F.contains(F.lower("text"), F.lower("term"))) for b in blocks))
    pattern = F.concat(F.lit(r"\b"), literal(F.col("term")), F.lit(r"\b")) if whole_word else literal(F.col("term"))
    own = [c for c in terms.columns if c not in PAGE]
    hits = both.select(*PAGE, *own, F.explode(matches(F.col("text"), pattern)).alias("hit"))
    hits = hits.withColumn("term", F.col("hit.text")) if as_written else hits
    return hits.select(*PAGE, *own, F.col("hit.start").cast("bigint").alias("start"), F.col("hit.end").cast("bigint").alias("end"))


def protect(detections: DataFrame, protected: DataFrame) -> DataFrame:
    """Detections that touch no protected span of their page."""
    a, b = detections.alias("a"), protected.alias("b")
    same = (F.col("a.container") == F.col("b.container")) & (F.col("a.page_no") == F.col("b.page_no"))
    return a.join(b, same & overlap(F.col("a.start"), F.col("a.end"), F.col("b.start"), F.col("b.end")), "left_anti")


def resolve(candidates: DataFrame, disjoint: bool) -> DataFrame:
    """Accepted candidates of each page, in the order of priority, length (longest first), term, start, end, type.

    A candidate is refused if its centre lies in an accepted one; with `disjoint`, if it touches one.
    """
    ranked = F.struct("priority", (-F.length("term")).alias("less"), "term", "start", "end", "entity_type")
    pages = candidates.groupBy(*PAGE).agg(F.array_distinct(F.sort_array(F.collect_list(ranked))).alias("all"))

    def clashes(x: Column, y: Column) -> Column:
        centre = (x["start"] + x["end"]) / 2
        return overlap(x["start"], x["end"], y["start"], y["end"]) if disjoint else (y["start"] <= centre) & (centre < y["end"])

    kept = F.aggregate("all", F.slice("all", F.lit(1), F.lit(0)), lambda acc, x: F.when(F.exists(acc, lambda y: clashes(x, y)), acc).otherwise(F.concat(acc, F.array(x))))
    rows = pages.select(*PAGE, F.explode(kept).alias("x"))
    return rows.select(*PAGE, *(F.col(f"x.{c}").alias(c) for c in ("priority", "term", "start", "end", "entity_type")))


def plan(blocked: DataFrame, found: DataFrame, protected: DataFrame | None = None, images: DataFrame | None = None, existing: DataFrame | None = None, disjoint: bool = False) -> DataFrame:
    """New redactions of each page: images, then block terms, then detections that touch nothing protected, resolved.

    images and existing: container, page_no, start, end. Marks that are there already come first; nothing is put on
    them, and they are no part of the result.
    """
    found = found if protected is None else protect(found, protected)
    parts = [(blocked, BLOCK), (found, DETECTION)]
    for spans, priority, term, entity in ((images, IMAGE, IMAGE_LABEL, "IMAGE"), (existing, EXISTING, "", "")):
        if spans is not None:
            parts.append((spans.withColumns({"term": F.lit(term), "entity_type": F.lit(entity)}), priority))
    columns = (*PAGE, "priority", "term", "start", "end", "entity_type")
    every = reduce(DataFrame.unionByName, (df.withColumn("priority", F.lit(priority)).select(*columns) for df, priority in parts))
    return resolve(every, disjoint).where(F.col("priority") != EXISTING)


def touching(items: DataFrame, redactions: DataFrame, keep: bool = False) -> DataFrame:
    """Items (with container, page_no, start, end) that touch a redaction, or with `keep` those that don't."""
    a, b = items.alias("a"), redactions.alias("b")
    same = (F.col("a.container") == F.col("b.container")) & (F.col("a.page_no") == F.col("b.page_no"))
    return a.join(b, same & overlap(F.col("a.start"), F.col("a.end"), F.col("b.start"), F.col("b.end")), "left_anti" if keep else "left_semi")


def at_point(redactions: DataFrame, points: DataFrame) -> DataFrame:
    """Redactions that hold a point of their page (points: container, page_no, at)."""
    a, b = redactions.alias("a"), points.alias("b")
    same = (F.col("a.container") == F.col("b.container")) & (F.col("a.page_no") == F.col("b.page_no"))
    return a.join(b, same & (F.col("a.start") <= F.col("b.at")) & (F.col("b.at") < F.col("a.end")), "left_semi")
