"""Exports: text rebuilt around disjoint spans, links and metadata out, restoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed import IMAGE_LABEL, MODES
from ..functions.text import collapse, entity_name, infer_type
from .review import read_payload
from .spans import PAGE

#: An invisible separator, put between a placeholder and a letter, digit, low line or placeholder beside it.
SEPARATOR = "\u2063"
#: Letters, digits and the low line.
WORD = r"[\p{L}\p{N}_]"


def rebuild(pages: DataFrame, spans: DataFrame, apart: bool = False) -> DataFrame:
    """Pages with their spans (container, page_no, start, end, replacement; disjoint) replaced. Pages without any keep their text.

    apart: a separator keeps replacements from letters, digits and other replacements beside them.
    """
    own = spans.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("start", "end", "replacement"))).alias("spans"))
    both = pages.select(*PAGE, "text").join(own, list(PAGE), "left")
    ends = F.concat(F.array(F.lit(0).cast("bigint")), F.transform("spans", lambda s: s["end"]))

    def piece(s: Column, i: Column) -> Column:
        at = F.get(F.col("ends"), i)
        gap = F.substring(F.col("text"), at.cast("int") + 1, F.greatest(s["start"] - at, F.lit(0)).cast("int"))
        if not apart:
            return F.concat(gap, s["replacement"])
        mark = lambda c: F.when(c, F.lit(SEPARATOR)).otherwise(F.lit(""))
        before = mark(((i > 0) & (s["start"] == at)) | gap.rlike(f"{WORD}\\z"))
        return F.concat(gap, before, s["replacement"], mark(F.substring(F.col("text"), s["end"].cast("int") + 1, F.lit(1)).rlike(WORD)))

    tail = F.substring(F.col("text"), F.element_at("ends", -1).cast("int") + 1, F.length("text"))
    whole = F.concat(F.array_join(F.transform("spans", piece), ""), tail)
    return both.withColumn("ends", ends).select(*PAGE, F.when(F.col("spans").isNull(), F.col("text")).otherwise(whole).alias("text"))


def merged(spans: DataFrame) -> DataFrame:
    """Spans of a page with those that touch joined, so that nothing under any of them stays."""
    place = Window.partitionBy(*PAGE).orderBy("start", "end")
    reach = F.max("end").over(place.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.select(*PAGE, "start", "end").withColumn("opens", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
    groups = opened.withColumn("part", F.sum("opens").over(place.rowsBetween(Window.unboundedPreceding, 0)))
    return groups.groupBy(*PAGE, "part").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("part")


def anonymize(pages: DataFrame, spans: DataFrame, mask: str = "") -> DataFrame:
    """Text under any span out, accepted or not; `mask` in its place."""
    return rebuild(pages, merged(spans).withColumn("replacement", F.lit(mask)))


def pseudonymize(pages: DataFrame, named: DataFrame) -> DataFrame:
    """Spans (disjoint, with placeholder) replaced by their placeholders, which stay apart from what is beside them."""
    return rebuild(pages, named.withColumn("replacement", F.col("placeholder")), apart=True)


def export(mode: str, pages: DataFrame, spans: DataFrame) -> DataFrame:
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is not one of {', '.join(MODES)}")
    return anonymize(pages, spans) if mode == "anonymize" else pseudonymize(pages, spans)


def named_marks(pages: DataFrame, marks: DataFrame) -> DataFrame:
    """Redactions (container, page_no, start, end, content) as values for the registry: what a mark's payload says goes first.

    Without a payload of ours the page's text under the mark is typed; a mark over no text stands for an image.
    """
    got = read_payload(F.col("content"))
    clipped = collapse(F.substring(F.col("text"), F.col("start").cast("int") + 1, F.greatest(F.col("end") - F.col("start"), F.lit(0)).cast("int")))
    both = marks.join(pages.select(*PAGE, "text"), list(PAGE)).withColumns({"said": got["original"], "kind": got["entity_type"], "clip": F.coalesce(clipped, F.lit(""))})
    value = F.coalesce("said", F.when(F.col("clip") != "", F.col("clip")), F.lit(IMAGE_LABEL))
    kind = F.coalesce("kind", F.when((F.col("clip") == "") & F.col("said").isNull(), "IMAGE").otherwise(infer_type(value)))
    return both.select(*PAGE, entity_name(kind).alias("entity_type"), value.alias("value"), "start", "end")


def save(texts: DataFrame, text_path: str, maps: DataFrame | None = None, map_path: str | None = None) -> None:
    """Write an export: the restore maps (container, content) first, in a place of their own, then the texts.

    A text with placeholders must not be there without its map; if the maps can't be written, no text is.
    """
    if (maps is None) != (map_path is None):
        raise ValueError("restore maps and their path go together")
    if maps is not None:
        ends = lambda p: p.rstrip("/") + "/"
        if ends(map_path).startswith(ends(text_path)) or ends(text_path).startswith(ends(map_path)):
            raise ValueError("restore maps are kept apart from the texts")
        maps.select("container", "content").write.mode("errorifexists").parquet(map_path)
    texts.write.mode("errorifexists").parquet(text_path)


def restore(pages: DataFrame, registry: DataFrame) -> DataFrame:
    """Placeholders back to originals, as whole tokens: a run of capitals, digits and low lines, and separators around it.

    Each container's registry is joined by token, so the registry's size doesn't matter. Values that a registry holds
    as one, such as two spellings, come back in its spelling.
    """
    token = f"{SEPARATOR}?(?<!{WORD})[A-Z][A-Z0-9_]*_[0-9]{{3,}}(?!{WORD}){SEPARATOR}?"
    gaps, tokens = F.split("text", token, -1), F.regexp_extract_all("text", F.lit(token), F.lit(0))
    parts = pages.where(F.col("text").rlike(token)).select(*PAGE, gaps.alias("gaps"), F.posexplode(tokens).alias("i", "written"))
    parts = parts.withColumn("placeholder", F.replace("written", F.lit(SEPARATOR), F.lit("")))
    back = parts.join(registry.select("container", "placeholder", "original"), ["container", "placeholder"], "left")
    piece = F.struct("i", F.concat(F.get("gaps", F.col("i")), F.coalesce("original", "written")).alias("text"))
    whole = back.groupBy(*PAGE).agg(F.sort_array(F.collect_list(piece)).alias("pieces"), F.first(F.element_at("gaps", -1)).alias("tail"))
    done = whole.select(*PAGE, F.concat(F.array_join(F.col("pieces.text"), ""), "tail").alias("restored"))
    return pages.join(done, list(PAGE), "left").select(*PAGE, F.coalesce("restored", "text").alias("text"))


def links(html: Column) -> Column:
    """Links of a page of markup with their places: array of (text, start, end)."""
    from ..functions.text import matches

    return matches(html, F.lit(r"<a\b[^>]*>[^<]*</a>"))


def without_metadata(html: Column) -> Column:
    """Markup without title and meta elements."""
    return F.regexp_replace(html, r"(?s)<title>.*?</title>|<meta\b[^>]*>", "")


def without_widgets(html: Column) -> Column:
    """Markup without form fields, whatever they hold."""
    return F.regexp_replace(html, r"(?s)<(select|textarea|button)\b.*?</\1>|<input\b[^>]*>", "")


def images(html: Column) -> Column:
    from ..functions.text import matches

    return matches(html, F.lit(r"<img\b[^>]*>"))
