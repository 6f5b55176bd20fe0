"""Detectors of personal data over pages (container, page_no, text).

Every detector gives rows (container, page_no, entity_type, value, start, end). Patterns are our own, from public
standards: E.164 numbers, ISO 13616 accounts, ISO/IEC 7812 cards, base58check and bech32 addresses. Names and places
need a model or a lexicon; the lexicon is the default.
"""

from __future__ import annotations

import hashlib
import sys
from functools import reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..fixed import ENTITIES, SHORTEST_TERM
from ..functions.text import MATCHES, clean_form, matches, strip

# The address check travels to the workers by value, so executors need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
PHONE = r"\+?[0-9][0-9 ().-]{6,}[0-9]"
#: Digits running on, in groups of four, or in groups of four, six and five; groups parted by spaces or hyphens.
CARD = r"[0-9]{13,}|[0-9]{4}(?: [0-9]{4}){2} [0-9]{1,7}|[0-9]{4}(?:-[0-9]{4}){2}-[0-9]{1,7}|[0-9]{4} [0-9]{6} [0-9]{5}|[0-9]{4}-[0-9]{6}-[0-9]{5}"
#: Written in one piece, or in groups of four and a rest.
IBAN = r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}|[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?"
CRYPTO = r"bc1[02-9ac-hj-np-z]{11,71}|[13][1-9A-HJ-NP-Za-km-z]{25,34}"

WORD = r"[\p{L}\p{N}_]+"

#: Terms of a dictionary up to which it is broadcast.
TERMS = 10_000

#: Priority of types where spans overlap, and order of detection.
ORDER = ("EMAIL_ADDRESS", "CREDIT_CARD", "IBAN_CODE", "CRYPTO", "PHONE_NUMBER", "PERSON", "LOCATION")


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def mod_97(account: Column) -> Column:
    """The check of ISO 7064: the account's number with its first four characters at the end, modulo 97."""
    moved = F.concat(F.substring(account, 5, 64), F.substring(account, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        letter = F.ascii(c) >= 65
        return F.when(letter, rest * 100 + F.ascii(c) - 55).otherwise(rest * 10 + F.ascii(c) - 48) % 97

    return F.aggregate(F.split(moved, ""), F.lit(0), lambda rest, c: F.when(c == "", rest).otherwise(step(rest, c)))


BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"


def base58check(address: str) -> bool:
    n = 0
    for c in address:
        n = n * 58 + BASE58.index(c)
    raw = n.to_bytes(-(-n.bit_length() // 8), "big")
    raw = bytes(len(address) - len(address.lstrip("1"))) + raw
    return len(raw) == 25 and hashlib.sha256(hashlib.sha256(raw[:21]).digest()).digest()[:4] == raw[21:]


def bech32(address: str) -> bool:
    """Checksum 1 for the first witness version, the later constant for the others."""
    head, _, tail = address.rpartition("1")
    if not head or len(tail) < 6 or any(c not in BECH32 for c in tail):
        return False
    data = [BECH32.index(c) for c in tail]
    check = 1
    for v in [ord(c) >> 5 for c in head] + [0] + [ord(c) & 31 for c in head] + data:
        top, check = check >> 25, (check & 0x1FFFFFF) << 5 ^ v
        check ^= reduce(lambda a, b: a ^ b, (g for i, g in enumerate((0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)) if top >> i & 1), 0)
    return check == (1 if data[0] == 0 else 0x2BC830A3)


@F.pandas_udf(BooleanType())
def crypto_valid(values: pd.Series) -> pd.Series:
    """Nulls are no addresses and pass."""
    return values.map(lambda v: v is None or (bech32(v) if v.startswith("bc1") else base58check(v)))


def compact(account: Column) -> Column:
    return F.replace(account, F.lit(" "), F.lit(""))


#: Of each entity: its pattern, a text without which nothing matches, and the condition on a match.
PATTERNS = {
    "EMAIL_ADDRESS": (EMAIL, "@", None),
    "PHONE_NUMBER": (PHONE, None, lambda v: F.length(digits(v)).between(7, 15)),
    "IBAN_CODE": (IBAN, None, lambda v: F.length(compact(v)).between(15, 34) & (mod_97(compact(v)) == 1)),
    "CREDIT_CARD": (CARD, None, lambda v: F.length(digits(v)).between(13, 19) & F.call_function("luhn_check", digits(v))),
    "CRYPTO": (CRYPTO, None, None),
}


def found(pages: DataFrame, *entities: str) -> DataFrame:
    """All matches of the patterns of these entities, in one pass over the pages."""

    def named(entity: str) -> Column:
        pattern, hint, _ = PATTERNS[entity]
        there = F.col("text").rlike(pattern)
        there = there if hint is None else F.contains("text", F.lit(hint)) & there
        hits = F.when(there, matches(F.col("text"), F.lit(pattern))).otherwise(F.array().cast(MATCHES))
        return F.transform(hits, lambda m: F.struct(F.lit(entity).alias("entity_type"), m["text"].alias("value"), m["start"].cast("bigint").alias("start"), m["end"].cast("bigint").alias("end")))

    rows = pages.select("container", "page_no", F.explode(F.concat(*map(named, entities))).alias("hit")).select("container", "page_no", "hit.*")
    rows = rows.where(F.length(strip(F.col("value"))) >= SHORTEST_TERM)
    valid = F.lit(True)
    for entity in entities:
        rule = PATTERNS[entity][2]
        valid = valid if rule is None else valid & F.when(F.col("entity_type") == entity, rule(F.col("value"))).otherwise(True)
    rows = rows.where(valid)
    if "CRYPTO" in entities:
        rows = rows.where(crypto_valid(F.when(F.col("entity_type") == "CRYPTO", F.col("value"))))
    return rows


def emails(pages: DataFrame) -> DataFrame:
    return found(pages, "EMAIL_ADDRESS")


def phones(pages: DataFrame) -> DataFrame:
    return found(pages, "PHONE_NUMBER")


def cards(pages: DataFrame) -> DataFrame:
    return found(pages, "CREDIT_CARD")


def ibans(pages: DataFrame) -> DataFrame:
    return found(pages, "IBAN_CODE")


def crypto(pages: DataFrame) -> DataFrame:
    return found(pages, "CRYPTO")


def lexicon(pages: DataFrame, names: DataFrame) -> DataFrame:
    """Names and places of a lexicon (term, entity_type), of one or more words, as whole words, case as written.

    The distinct words of a page meet the first words of the terms in an equi join, whatever the lexicon's size; only
    terms whose first word occurs are then looked up in the page's text. A term without a word matches nothing.
    """
    words = pages.select("container", "page_no", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).alias("word"))
    terms = names.select(F.regexp_extract("term", WORD, 0).alias("word"), F.col("term").alias("value"), "entity_type").where("word <> ''")
    there = words.join(terms, "word").where(F.length("value") >= SHORTEST_TERM).drop("word")
    quoted = F.concat(F.lit(r"\Q"), F.replace("value", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    pattern = F.concat(F.lit(f"(?<!{WORD[:-1]})"), quoted, F.lit(f"(?!{WORD[:-1]})"))
    hits = pages.join(there, ["container", "page_no"]).where(F.contains("text", "value")).select("container", "page_no", "entity_type", "value", F.explode(matches(F.col("text"), pattern)).alias("hit"))
    return hits.select("container", "page_no", "entity_type", "value", F.col("hit.start").cast("bigint").alias("start"), F.col("hit.end").cast("bigint").alias("end"))


def detect(pages: DataFrame, entities: tuple[str, ...] = ENTITIES, names: DataFrame | None = None) -> DataFrame:
    """The union of the detectors asked for; all patterns share one pass."""
    unknown = set(entities) - set(ENTITIES)
    if unknown:
        raise ValueError(f"no such entity: {', '.join(sorted(unknown))}")
    own = [name for name in PATTERNS if name in entities]
    parts = [found(pages, *own)] if own else []
    if names is not None or not parts:
        lexical = lexicon(pages, names) if names is not None else pages.sparkSession.createDataFrame([], "container string, page_no bigint, entity_type string, value string, start bigint, end bigint")
        parts.append(lexical.where(F.col("entity_type").isin(*entities)))
    return reduce(DataFrame.unionByName, parts)


def per_value(detections: DataFrame) -> DataFrame:
    """One row a page and value: the first place, the type seen last. seq: order of the sightings."""
    return detections.groupBy("container", "page_no", F.col("value").alias("value")).agg(F.min("seq").alias("seq"), F.max_by("entity_type", "seq").alias("entity_type"))


def allowed_exactly(detections: DataFrame, allow: DataFrame) -> DataFrame:
    """Detections but those whose clean form is a term, or empty.

    A dictionary of at most TERMS terms is broadcast, so that no detection moves. A larger one first meets the distinct
    values, which are partly summed up before they move; only values that it holds are then taken out.
    """
    terms = allow.select(F.col("term").alias("clean")).distinct()
    if terms.limit(TERMS + 1).count() <= TERMS:
        clean = detections.withColumn("clean", clean_form(F.col("value"))).where("clean <> ''")
        return clean.join(F.broadcast(terms), "clean", "left_anti")
    values = detections.select("value").distinct().withColumn("clean", clean_form(F.col("value")))
    gone = values.join(terms, "clean", "left_semi").select("value")
    return detections.join(gone, "value", "left_anti").withColumn("clean", clean_form(F.col("value"))).where("clean <> ''")


def allowed_fuzzily(detections: DataFrame, allow: DataFrame) -> DataFrame:
    """Detections (with clean) but those that hold a term, or are held by one, as whole words.

    The distinct clean forms meet the terms, not the detections; a word that both share is the key of the join, as
    one in the other means that the shorter one's words are words of the longer. A term without any word character
    has no word boundary of its own to be found at and meets nothing.
    """
    word = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(WORD), F.lit(0)))
    forms = detections.select("clean").distinct()
    a, b = forms.select("clean", F.explode(word(F.col("clean"))).alias("key")), allow.select("term", F.explode(word(F.col("term"))).alias("key"))
    pairs = a.join(b, "key").select("clean", "term").distinct()
    quoted = lambda c: F.concat(F.lit(r"\b\Q"), c, F.lit(r"\E\b"))
    hit = pairs.where(F.regexp_like("clean", quoted(F.col("term"))) | F.regexp_like("term", quoted(F.col("clean"))))
    return detections.join(hit.select("clean").distinct(), "clean", "left_anti")
