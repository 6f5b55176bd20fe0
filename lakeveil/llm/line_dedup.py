"""Line dedup: an exact set-similarity join over lines, in DataFrame functions alone.

A line is the set of its distinct five-word shingles, its tokens. Tokens are ordered by the rarity of their first word,
for which its length stands (a long word is rare, and counting all words takes a pass over the texts), then by that
word's hash, then by the hash of all five. Any order gives the same result. Two lines with a Jaccard similarity of 0.8 or more share a token among the first n - ceil(0.8 n) + 1
of the longer and the first n - ceil(8/9 n) + 1 of the shorter (prefix filter). Lengths and the places of the shared
token bound the overlap further (length and positional filters), and 256 parities of the tokens bound the difference
from below; what remains is verified on the whole sets.

A line is removed if an earlier one (by key, then place) matches it, whether or not that one is removed itself. One
earlier match is enough, so lines that share a token are compared in rounds: first with the earliest of them, then the
lines without a match so far with samples of the others that grow eightfold, at last with all of them. A line with
many matches is settled by a small sample, so the compared pairs grow with the lines and not with the square of a
family's size; lines without any match meet all that the filters let through.

Steps: (1) every line's prefix, for which only the prefix's shingles are hashed; (2) tokens that different lines
share, counted with map-side sums; (3) whole sets of the lines that have one; (4) the rounds; (5) the documents rebuilt.

A line of fewer words than a shingle has no token; only a line of the same words matches it, so it is known by the hash
of its words and needs no join. Blank lines are left alone. Lines are parted at line feeds, words at white space of any
kind, so lines that differ in white space alone are the same. Null texts stay null and have no lines; rows with a null
key keep their text and take no part. Rows with one key are not told apart: equal lines at the same place of them
count as one place and stay, others there are ordered by their hash. Other columns stay as they are, whatever their
names. Very long lines are sets like others. An empty table gives an empty result.

Words are known by their length and 60 bits, lines by 128 bits, tokens by 64 bits (20 of the first word, 44 of all five).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import clean_shuffles, forget, materialize

WIDTH = 5
#: Rows of a few numbers each up to which a table is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 500_000
#: The same for a table of one number a row, and numbers up to which a table of arrays is.
BROADCAST_TOKENS = 2_000_000
#: Lines of a token that the rounds after the first compare with, as expected sizes of samples; the last round takes all.
SAMPLES = (8, 64, 512)
#: Copies of a line's row that its occurrences are dealt to.
SALT = 16
#: Bits of a token that are of all its words; above them are the first of its first word's.
HASH = (1 << 44) - 1
MOST = (1 << 63) - 1
#: Bits of a word that are of its hash; above them is its level.
WORD = (1 << 60) - 1
#: By the bytes of a word, what its level adds to it; words of 16 bytes or more have the least.
LEVELS, LEAST = [(8 - max(n, 1)) << 60 for n in range(16)], -8 << 60
#: White space but the space and the line feed, and what their UTF-8 forms begin with, as hexadecimal digits.
OTHER_SPACE = r"[\t\x0B\f\r\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
ASCII_MARKS, WIDE_MARKS = ("09", "0B", "0C", "0D"), ("C285", "C2A0", "E19A80", "E280", "E2819F", "E38080")


def spaced(text: Column) -> Column:
    """The text with spaces for all white space but line feeds; places stay. Plain searches go before the pattern; counting characters would cost more than all of them."""
    raw = text.cast("binary")
    odd = reduce(Column.__or__, (F.contains(raw, F.lit(bytes.fromhex(m))) for m in (*ASCII_MARKS, *WIDE_MARKS)))
    return F.when(odd, F.regexp_replace(text, OTHER_SPACE, " ")).otherwise(text)


def rarity_levels(texts: DataFrame | None = None) -> Column:
    """A constant array: by the bytes of a word, its level as high bits; nothing is read off the texts."""
    return F.from_json(F.lit(str(LEVELS)), "array<bigint>")


def lines_of(docs: DataFrame) -> DataFrame:
    """(key, no, line) of the lines that aren't blank. docs: key, text, neither null."""
    return docs.select("key", F.posexplode(F.split(spaced(F.col("text")), "\n")).alias("no", "line")).where(F.trim("line") != "")


def lines_at(docs: DataFrame, at: DataFrame) -> DataFrame:
    """(no, ord, own, line) of the lines at chosen places. docs: key, text, neither null; at: key, places (an array of no, ord, own).

    A text is parted once, in a lambda's argument; only the lines asked for become rows, and are searched for white space.
    """
    chosen = F.transform(F.array(F.split("text", "\n")), lambda lines: F.transform("places", lambda p: F.struct(p.no, p.ord, p.own, F.get(lines, p.no).alias("line"))))
    return docs.join(at, "key").select(F.inline(F.get(chosen, F.lit(0)))).where("line is not null").withColumn("line", spaced(F.col("line")))


def hashed(lines: DataFrame) -> DataFrame:
    """With the hashes of the line's words (h; a longer word's is less), and of all of them (id), in place of the line."""
    gaps = F.contains("line", F.lit("  ")) | F.startswith("line", F.lit(" ")) | F.endswith("line", F.lit(" "))
    words = F.when(gaps, F.array_remove(F.split("line", " "), "")).otherwise(F.split("line", " "))
    level = lambda w: F.coalesce(F.get(rarity_levels(), F.octet_length(w)), F.lit(LEAST))
    words = lines.withColumn("h", F.transform(words, lambda w: F.xxhash64(w).bitwiseAND(F.lit(WORD)).bitwiseOR(level(w)))).drop("line")
    return words.withColumn("id", F.struct(F.xxhash64("h").alias("a"), F.xxhash64(F.lit(1), "h").alias("b")))


def starts(h: Column) -> Column:
    """The first words of a line's shingles."""
    return F.slice(h, F.lit(1), F.greatest(F.size(h) - (WIDTH - 1), F.lit(0)))


def token(start: Column, h: Column, at: Column) -> Column:
    words = F.xxhash64(*(F.get(h, at + k) for k in range(WIDTH)))
    return start.bitwiseAND(F.lit(~HASH)).bitwiseOR(words.bitwiseAND(F.lit(HASH)))


def longer_prefix(n: Column) -> Column:
    """Tokens of a set of n of which a match that is no longer has one in its own shorter prefix."""
    return (n - F.ceil(n * 4 / F.lit(5.0) - 1e-9) + 1).cast("int")


def shorter_prefix(n: Column) -> Column:
    return (n - F.ceil(n * 8 / F.lit(9.0) - 1e-9) + 1).cast("int")


def prefixes(lines: DataFrame, levels: Column | None = None) -> DataFrame:
    """(key, no, a, b, token) of lines (key, no, id, h): a row without a token for each line, and one (a, token) for each token of its prefix.

    A prefix takes as many different first words as the prefix of a set of all the line's shingles has tokens, and
    every shingle whose first word is not above them in the bits that order tokens, so only these shingles are hashed.
    Few first words repeat, so they are looked for among twice as many, and among all where these don't suffice. The
    sort is in a step of its own and not in a lambda, where it would sort objects. levels: not used, as words have theirs.
    """
    started = lines.withColumn("start", starts(F.col("h")))
    most, in_order = longer_prefix(F.size("start")), F.sort_array("start")
    last = F.coalesce(F.get(F.array_distinct(F.slice(in_order, F.lit(1), most * 2)), most - 1), F.get(F.array_distinct(in_order), most - 1), F.lit(MOST))
    cut = started.withColumn("cut", last.bitwiseOR(F.lit(HASH)))
    whole = F.col("i") == 0
    rows = cut.select("key", "no", "id", "h", "cut", F.posexplode(F.concat(F.array(F.lit(0).cast("bigint")), "start")).alias("i", "x")).where(whole | (F.col("x") <= F.col("cut")))
    return rows.select(F.when(whole, F.col("key")).alias("key"), F.when(whole, F.col("no")).alias("no"), F.col("id.a").alias("a"), F.when(whole, F.col("id.b")).alias("b"), F.when(~whole, token(F.col("x"), F.col("h"), F.col("i") - 1)).alias("token"))


def with_sets(lines: DataFrame) -> DataFrame:
    """Lines (at least WIDTH words; h) with their tokens in order. The hashes are a lambda's argument, which is cheaper to look into than a column."""
    whole = F.transform(F.array("h"), lambda h: F.transform(starts(h), lambda x, i: token(x, h, i)))
    return lines.withColumn("tokens", F.array_distinct(F.sort_array(F.get(whole, F.lit(0))))).drop("h")


def sizes_of(sets: DataFrame) -> DataFrame:
    """(ord, n, s0 to s3): the number of tokens of each set and 256 parities of them."""
    each = sets.select("ord", F.explode("tokens").alias("t"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("t").bitwiseAND(F.lit(63)).cast("int"))
    part = F.col("t").bitwiseAND(F.lit(192))
    return each.groupBy("ord").agg(F.count("*").cast("int").alias("n"), *(F.bit_xor(F.when(part == 64 * i, bit).otherwise(F.lit(0).cast("bigint"))).alias(f"s{i}") for i in range(4)))


def least_overlap(a: Column, b: Column) -> Column:
    """Shared tokens that sets of sizes a and b need for a similarity of 0.8."""
    return F.ceil((a + b) * 4 / F.lit(9.0) - 1e-9)


def could_match(placed: bool) -> Column:
    """Length filter and parities for rows of a and b; with the places p (from 0) of a shared token, prefix and positional filters, too."""
    n, m = F.col("a.n"), F.col("b.n")
    need = least_overlap(n, m)
    apart = reduce(Column.__add__, (F.bit_count(F.col(f"a.s{i}").bitwiseXOR(F.col(f"b.s{i}"))) for i in range(4)))
    fits = (F.least(n, m) * 5 >= F.greatest(n, m) * 4) & (apart <= n + m - 2 * need)
    if not placed:
        return fits
    p, q = F.col("a.p"), F.col("b.p")
    prefix = F.when(n <= m, p < shorter_prefix(n)).otherwise(q < shorter_prefix(m))
    return fits & prefix & (F.least(p, q) + F.least(n - p, m - q) >= need)


def matches(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The lines (ord) of pairs (ord, earlier) whose sets are similar enough. Only sets that a pair names are moved."""
    pairs = materialize(pairs, "pairs")
    named = small_side(pairs)
    one = named.join(sets.select("ord", F.col("tokens").alias("x")), "ord")
    other = sets.select(F.col("ord").alias("earlier"), F.col("tokens").alias("y")).join(named.select("earlier"), "earlier", "left_semi")
    both = one.join(other, "earlier").withColumn("common", F.size(F.array_intersect("x", "y")))
    return both.where(F.col("common") * 5 >= (F.size("x") + F.size("y") - F.col("common")) * 4).select("ord").distinct()


def small_side(df: DataFrame, most: int | None = None) -> DataFrame:
    """Marked for broadcast if it has few rows, else as it is. df: a written table of numbers."""
    return F.broadcast(df) if df.count() <= (BROADCAST_ROWS if most is None else most) else df


def repeats(sets: DataFrame, shared: DataFrame) -> DataFrame:
    """The lines (ord) that an earlier one matches. sets: ord (their order), tokens; shared: a written table of all tokens that two lines' prefixes may share."""
    sizes = materialize(sizes_of(sets), "sizes")
    rows = sets.select("ord", F.posexplode(F.slice("tokens", F.lit(1), longer_prefix(F.size("tokens")))).alias("p", "token"))
    rows = rows.join(small_side(shared, BROADCAST_TOKENS), "token", "left_semi")
    groups = rows.groupBy("token").agg(F.min("ord").alias("first"), F.count("*").alias("many")).where("many > 1")
    met = materialize(rows.join(groups, "token").join(small_side(sizes), "ord"), "met")

    earliest = met.where("first < ord").select("ord", "first", "n", "s0", "s1", "s2", "s3").distinct().alias("a")
    earliest = earliest.join(sizes.alias("b"), F.col("a.first") == F.col("b.ord")).where(could_match(False))
    found = materialize(matches(earliest.select(F.col("a.ord").alias("ord"), F.col("a.first").alias("earlier")), sets), "found")

    share = F.pmod(F.xxhash64("ord"), F.lit(1 << 20)) * F.col("many") / F.lit(float(1 << 20))  # places a line among those of a token, at random
    largest = met.agg(F.max("many")).first()[0] or 0
    least = 0.0
    for most in (*SAMPLES, None):
        if largest <= max(2.0, least):
            break
        more = met.where(F.col("many") > max(2.0, least))  # of other tokens all lines have been met
        rest = more.join(small_side(found), "ord", "left_anti")
        others = more.where(share >= least) if most is None else more.where((share >= least) & (share < most))
        met_again = rest.alias("a").join(others.alias("b"), (F.col("a.token") == F.col("b.token")) & (F.col("b.ord") < F.col("a.ord")) & (F.col("b.ord") != F.col("a.first")) & could_match(True))
        pairs = met_again.select(F.col("a.ord").alias("ord"), F.col("b.ord").alias("earlier")).distinct()
        new = materialize(found.unionByName(matches(pairs, sets)), "found")
        forget(found)
        found, least = new, float(most or 0)
    forget(met, sizes)
    return found


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of the documents with all its columns, the text without its repeated lines, and n_lines and n_removed."""
    df = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text")).where("key is not null and text is not null")
    rows = materialize(prefixes(hashed(lines_of(df))), "prefixes", {"parquet.enable.dictionary#token": "false"})
    every = materialize(rows.where("token is null").select("key", "no", F.struct("a", "b").alias("id")), "lines")
    tokens = rows.where("token is not null").select("a", "token")

    shared = materialize(tokens.groupBy("token").agg(F.min("a").alias("lo"), F.max("a").alias("hi")).where("lo <> hi").select("token"), "shared")
    some = materialize(tokens.join(small_side(shared, BROADCAST_TOKENS), "token").select("a").distinct(), "some")
    first = every.join(small_side(some), F.col("id.a") == F.col("a"), "left_semi").groupBy("id").agg(F.min(F.struct("key", "no")).alias("at"))
    ordered = materialize(first.orderBy("at", "id").select("id", "at", F.monotonically_increasing_id().alias("ord")), "ordered")
    at = ordered.groupBy("at.key").agg(F.collect_list(F.struct(F.col("at.no").alias("no"), "ord", F.col("id").alias("own"))).alias("places"))  # lines of one document
    at = materialize(at, "at")
    there = hashed(lines_at(df, small_side(at))).select("ord", "h", F.coalesce(F.col("id") == F.col("own"), F.lit(False)).alias("same"))
    every_set = materialize(with_sets(there), "sets")
    sets = every_set.where("same").drop("same")  # tested where it is read, lest the test hash the words again
    if sets.count() > ordered.count():  # rows that occur more than once
        sets = materialize(sets.dropDuplicates(["ord"]), "sets")
    removed = repeats(sets, shared).join(ordered.select("ord", "id"), "ord").select("id", F.lit(True).alias("gone"))
    forget(rows, shared, some, at, every_set, sets)

    again = materialize(every.groupBy("id").agg(F.count("*").alias("copies")).where("copies > 1").select("id"), "again")
    copies = every.join(small_side(again), "id", "left_semi").groupBy("id").agg(F.min(F.struct("key", "no")).alias("first"))
    flags = copies.join(removed, "id", "full").select("id", "first", F.coalesce("gone", F.lit(False)).alias("gone"))
    flags = materialize(flags, "flags")
    if flags.count() <= BROADCAST_ROWS:
        marked = every.select("key", "no", "id").join(F.broadcast(flags), "id")
    else:
        salted = flags.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
        marked = every.select("key", "no", "id", F.pmod(F.xxhash64("key"), F.lit(SALT)).cast("int").alias("salt")).join(salted, ["id", "salt"])
    gone = marked.where(F.col("gone") | (F.struct("key", "no") != F.col("first"))).groupBy("key").agg(F.collect_set("no").alias("gone"))
    gone = materialize(gone, "gone")
    forget(every, ordered, again, flags)
    clean_shuffles(docs.sparkSession)
    return without_lines(docs, gone, key, text)


def without_lines(docs: DataFrame, gone: DataFrame, key: str, text: str) -> DataFrame:
    """The documents without the lines whose places are in gone (key, gone), a written table; where these are few, the documents aren't moved."""
    own = [c for c in docs.columns if c != text]
    df = docs.select(F.struct(*own).alias("_row"), docs[key].alias("_key"), docs[text].cast("string").alias("_text"))
    places = gone.select(F.col("key").alias("_key"), F.col("gone").alias("_gone"))
    numbers = gone.agg(F.sum(F.size("gone") + 1)).first()[0] or 0
    df = df.join(F.broadcast(places) if numbers <= BROADCAST_TOKENS else places.hint("shuffle_hash"), "_key", "left")
    lines = F.split("_text", "\n")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone"), lambda i: F.get("_lines", i))
    out = df.withColumn("_lines", F.when(F.size("_gone") > 0, lines))
    n_lines = F.when(F.col("_text") == "", 0).otherwise(F.octet_length("_text") - F.octet_length(F.replace("_text", F.lit("\n"), F.lit(""))) + 1)
    fields = [F.array_join(kept, "\n") if c == text else F.col(f"_row.{c}") for c in docs.columns]
    fields = [F.when(F.size("_gone") > 0, x).otherwise(F.col("_text")).alias(c) if c == text else x.alias(c) for c, x in zip(docs.columns, fields)]
    return out.select(*fields, F.coalesce(n_lines, F.lit(0)).cast("bigint").alias("n_lines"), F.coalesce(F.when(F.size("_gone") > 0, F.size("_gone")), F.lit(0)).cast("bigint").alias("n_removed"))
