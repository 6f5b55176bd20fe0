"""Text as columns: white space, clean forms, types of values, escapes, offsets of matches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import DEFAULT_ENTITY, SEVERITIES, TYPED_CARD, TYPED_EMAIL, TYPED_IBAN, TYPED_PHONE

#: Unicode white space, for Java and RE2 alike.
SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
PUNCTUATION = r"[!-/:-@\[-\x60{-~]"


def strip(text: Column, chars: str = SPACE) -> Column:
    return F.regexp_replace(text, f"^{chars}+|{chars}+\\z", "")


def collapse(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.btrim(F.regexp_replace(text, f"{SPACE}+", " "))


def clean_form(text: Column) -> Column:
    """The form in which values meet dictionary terms: outer punctuation off, lower case, white space collapsed."""
    return collapse(F.lower(strip(text, PUNCTUATION)))


def folded(text: Column) -> Column:
    """The form in which two spellings are the same value."""
    return F.lower(F.replace(collapse(text), F.lit("ß"), F.lit("ss")))


def entity_name(name: Column) -> Column:
    """An entity type as placeholders write it; nothing sensible becomes the default."""
    clean = F.btrim(F.regexp_replace(F.upper(F.coalesce(name, F.lit(""))), "[^A-Z0-9_]+", "_"), F.lit("_"))
    return F.when(clean == "", DEFAULT_ENTITY).otherwise(clean)


def infer_type(value: Column, fixed: bool = False) -> Column:
    """The type of a hand-marked value. As specified, cards look like phones first; `fixed` tries cards with their check digit before."""
    compact = collapse(value)
    joined = F.replace(compact, F.lit(" "), F.lit(""))
    card = joined.rlike(TYPED_CARD)
    out = F.when(compact.rlike(TYPED_EMAIL), "EMAIL_ADDRESS").when(joined.rlike(TYPED_IBAN), "IBAN_CODE")
    if fixed:
        out = out.when(card & F.call_function("luhn_check", F.regexp_extract(joined, TYPED_CARD, 0)), "CREDIT_CARD")
    return out.when(compact.rlike(TYPED_PHONE), "PHONE_NUMBER").when(card, "CREDIT_CARD").otherwise(DEFAULT_ENTITY)


def escape_html(text: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def log_severity(line: Column) -> Column:
    (word, name), *rest = SEVERITIES
    out = F.when(F.contains(line, F.lit(word)), name)
    for word, name in rest:
        out = out.when(F.contains(line, F.lit(word)), name)
    return out.otherwise("info")


def progress(done: Column, total: Column) -> Column:
    return F.when(total <= 0, 0).otherwise((done * 100 / total).cast("int"))


#: Matches whose offsets are summed up together; sums of these sums give each block its start.
OFFSETS = 256
MATCHES = "array<struct<text:string,start:int,end:int>>"


def matches(text: Column, pattern: Column) -> Column:
    """All matches of a pattern: array of (text, start, end), code points from 0, end exclusive.

    Offsets are running sums of the lengths of gaps and matches, within blocks and then over blocks, as a fold copies
    what it has gathered at every step.
    """
    pairs = F.zip_with(F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1), lambda x, gap: F.struct(x.alias("text"), F.length(gap).alias("gap")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["text"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(x["text"].alias("text"), start.alias("start"), end.alias("end")))).alias("out"))

    def block(rows: Column) -> Column:
        return F.aggregate(rows, F.struct(F.lit(0).alias("at"), F.array().cast(MATCHES).alias("out")), step)

    def in_blocks(rows: Column) -> Column:
        n = F.size(rows) - 1  # the last gap has no match after it
        return F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(OFFSETS)), lambda at: block(F.slice(rows, at, F.least(F.lit(OFFSETS), F.greatest(n - at + 1, F.lit(0))))))

    def placed(blocks: Column) -> Column:
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        starts = F.aggregate(blocks, none, lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")), lambda acc: acc["starts"])
        return F.flatten(F.zip_with(blocks, starts, lambda x, at: F.transform(x["out"], lambda m: F.struct(m["text"].alias("text"), (m["start"] + at).alias("start"), (m["end"] + at).alias("end")))))

    once = F.transform(F.array(pairs), in_blocks)  # lambdas' arguments are worked out once
    return F.get(F.transform(once, placed), F.lit(0))


def literal(term: Column) -> Column:
    """A pattern that finds the term itself, in either case."""
    return F.concat(F.lit(r"(?iu)\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def whole_word(term: Column) -> Column:
    """A pattern that finds the term between word boundaries, case as written."""
    return F.concat(F.lit(r"\b\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\b"))


def html_text(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags out, five entities back, white space collapsed."""
    text = F.regexp_replace(html, r"(?s)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(mark))
    return collapse(text)
