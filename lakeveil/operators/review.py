"""Review of redactions (container, page_no, start, end, original, entity_type, origin): add, remove, clear, payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import IMAGE_LABEL
from ..functions.text import collapse, infer_type
from .spans import PAGE, at_point

PAYLOAD = "struct<mark:int,original:string,entity_type:string>"
MARK = 1


def payload(original: Column, entity: Column) -> Column:
    """JSON that a redaction carries; none for an empty original."""
    clean = collapse(original)
    return F.when(clean != "", F.to_json(F.struct(F.lit(MARK).alias("mark"), clean.alias("original"), entity.alias("entity_type"))))


def read_payload(content: Column) -> Column:
    """The payload of a redaction of ours, else null: JSON that parses and has our mark."""
    got = F.from_json(content, PAYLOAD)
    return F.when(got["mark"] == MARK, got)


def manual(pages: DataFrame, marks: DataFrame) -> DataFrame:
    """Redactions for hand-drawn spans (container, page_no, start, end): text is typed, a span without text is an image."""
    text = collapse(F.substring(F.col("text"), F.col("start").cast("int") + 1, F.greatest(F.col("end") - F.col("start"), F.lit(0)).cast("int")))
    both = marks.join(pages.select(*PAGE, "text"), list(PAGE)).withColumn("original", text)
    empty = F.col("original") == ""
    return both.select(*PAGE, "start", "end", F.when(empty, IMAGE_LABEL).otherwise(F.col("original")).alias("original"), F.when(empty, "IMAGE").otherwise(infer_type(F.col("original"))).alias("entity_type"), F.lit("manual").alias("origin"))


def remove_at(redactions: DataFrame, points: DataFrame) -> DataFrame:
    """Redactions left when all that hold a point are taken away."""
    gone = at_point(redactions, points)
    return redactions.join(gone.select(*PAGE, "start", "end").distinct(), [*PAGE, "start", "end"], "left_anti")


def clear_page(redactions: DataFrame, container: str, page_no: int) -> DataFrame:
    return redactions.where(~((F.col("container") == container) & (F.col("page_no") == page_no)))
