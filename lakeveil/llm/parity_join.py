"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct word shingles, as 64-bit hashes. Sets of one size band and the next are joined:
two sets of at most a and b shingles with a Jaccard similarity of t or more differ in D = (a + b)(1 - t) / (1 + t)
shingles at most. Every band cuts the hash space into D + 1 + e parts. In a part, each shingle flips one bit of a
64-bit word, so the Hamming distance of two sketches is at most the symmetric difference, and of the words at least
e + 1 must be equal (pigeonhole). A part with few shingles says little, so a set leaves out its e parts with the
fewest (ties: the lesser part) and emits a key for each of the others: the word, the count, and the XOR of the
shingles' hashes, which tells apart sets of few shingles that flip the same bits. Of the equal parts, which have equal
counts, the last in that order is left out by neither set.

The keys are joined in PARTS parts, one after the other, each from a column of its own. Sets that share a key form
families (connected components). Keys that sets share by chance make large families of sets that hardly resemble each
other, the more so the larger the input, so a family is compared in blocks of about BLOCK sets, cut by size, each with
those that its sizes admit, and in passes, so that the disk holds the copies of one pass: a second sketch of 1,024 bits
rules pairs out by its Hamming distance, and a pair that isn't joined yet is verified on the whole sets. Pairs are never
written: a task gives the links that join its sets, a spanning forest. Components of those links, with the copies of
equal sets put back, are the result.

Null, empty and blank texts have no shingles and link with nothing, not even each other. A text of fewer words than
a shingle is one shingle. Repeated rows and equal texts are copies of one set. Rows with a null key are kept, and link.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import MEMO, column, forget, materialize, per_slice, texts, worker_memory

#: Sets of a family, about, that one task compares with each other, or with as many others.
BLOCK = 1024
#: Shingles that a block holds about at most; one larger set is a block of its own.
BLOCK_SHINGLES = 1 << 21
#: Shingles of a pass over large families at least, so that small inputs take one.
LEAST_PASS = 1 << 24
#: Pairs of blocks up to which they are broadcast.
BROADCAST_ROWS = 100_000
#: Sets of small families that one task works off.
TOGETHER = 2048
SKETCH_BITS = 1024
#: Bits of the filter that says which sets have a family.
FILTER_BITS = 1 << 26
#: Copies of a class's row that its documents are dealt to.
SALT = 16
#: Parts of the sketch keys that are joined one after the other, so that the disk holds the shuffle files of one part.
PARTS = 4
PART_NAMES = [f"keys{i}" for i in range(PARTS)]

U = np.uint64


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class WordHashes(dict):
    """64-bit hashes of words, memorised; emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of `width` words; A-Z lower-cased, words parted at space, tab and line ends."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, U)
    known = worker_memory().setdefault("word_hashes", WordHashes())
    h = np.fromiter(map(known.__getitem__, words), U, len(words))
    n = min(width, len(words))
    out = np.full(len(words) - n + 1, U(n), U)
    for i in range(n):
        out = mixed(out * U(0x9E3779B97F4A7C15) + h[i : len(words) - n + 1 + i])
    return np.unique(out)


def set_id(hashes: np.ndarray) -> int:
    """A signed 64-bit id of a set."""
    import xxhash

    return int(np.array(xxhash.xxh3_64_intdigest(hashes.tobytes()), U).view(np.int64))


class Bands:
    """Size bands for a similarity of num / den: linked sets lie in one band or two neighbours."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.edges = num, den, [0, 1]

    def most_apart(self, a, b):
        """The largest symmetric difference of linked sets of sizes a and b."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def of(self, size: int) -> int:
        while self.edges[-1] <= size:
            self.edges.append(self.edges[-1] * self.den // self.num + 1)
        return int(np.searchsorted(self.edges, size, side="right")) - 1

    def apart(self, band: int) -> int:
        """The same for a set of a band with one of it or the next."""
        while len(self.edges) <= band + 1:
            self.of(self.edges[-1])
        a = self.edges[band + 1] - 1
        return self.most_apart(a, a * self.den // self.num)

    def keys(self, h: np.ndarray) -> np.ndarray:
        """Sketch words as keys, of the set's band and the one below."""
        band, out = self.of(len(h)), []
        bits, whole = U(1) << (h & U(63)), mixed(h)
        for group in (band - 1, band):
            apart = self.apart(group) if group > 0 else 0
            if not apart:
                continue  # only equal sets link
            extra = 2 + 3 * apart // 10
            parts = apart + 1 + extra
            part = ((h >> U(32)) * U(parts)) >> U(32)
            starts = np.flatnonzero(np.diff(part, prepend=U(parts)))
            words, hashes, counts = np.zeros(parts, U), np.zeros(parts, U), np.zeros(parts, np.int64)
            words[part[starts]] = np.bitwise_xor.reduceat(bits, starts)
            hashes[part[starts]] = np.bitwise_xor.reduceat(whole, starts)
            counts[part[starts]] = np.diff(starts, append=len(h))
            strong = np.argsort(counts, kind="stable")[extra:]
            name = (strong.astype(U) * U(1 << 20) + counts[strong].astype(U)) * U(0x9E3779B97F4A7C15) + U(group)
            out.append(mixed(mixed(name ^ words[strong]) ^ hashes[strong]))
        return np.concatenate(out) if out else np.zeros(0, U)


def fingerprints(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(key, n, node, keys0 to keys3): size and id of each document's set, and its sketch keys in parts where a task meets the set first. docs: key, text."""

    def run(batches):
        seen, bands = set(), Bands(num, den)

        def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, nodes, keys = [], [], [[] for _ in range(PARTS)]
            for text in texts(batch):
                h = shingle_set(text, width)
                node = set_id(h) if len(h) else None
                n.append(len(h))
                nodes.append(node)
                own = None
                if node is not None and node not in seen:
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(node)
                    own = bands.keys(h)
                for i, part in enumerate(keys):
                    part.append(None if own is None else own[own % U(PARTS) == i].view(np.int64))
            columns = [pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), *(pa.array(part, pa.list_(pa.int64())) for part in keys)]
            return pa.RecordBatch.from_arrays([column(batch, "key"), *columns], names=["key", "n", "node", *PART_NAMES])

        yield from per_slice(rows)(batches)

    schema = T.StructType([docs.schema["key"], T.StructField("n", T.LongType()), T.StructField("node", T.LongType()), *(T.StructField(c, T.ArrayType(T.LongType())) for c in PART_NAMES)])
    return docs.mapInArrow(run, schema)


def stars(prints: DataFrame, part: str) -> DataFrame:
    """(u, v): sets that share a key of a part with others, each with the least of these; written, so that the shuffle files can go."""
    shared = prints.where(F.col(part).isNotNull()).select("node", F.explode(part).alias("k"))
    shared = shared.withColumn("least", F.min("node").over(Window.partitionBy("k"))).where("node <> least")
    return materialize(shared.select(F.col("node").alias("u"), F.col("least").alias("v")).distinct(), "stars")


def node_filter(nodes: DataFrame) -> np.ndarray:
    """A bitmap of FILTER_BITS bits, whatever the number of nodes: says no only for nodes that aren't there."""
    bits = nodes.select(F.pmod(F.col("node"), F.lit(FILTER_BITS)).alias("b")).where("b > 0")
    maps = bits.selectExpr("bitmap_bucket_number(b) as bucket", "bitmap_bit_position(b) as position")
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in maps.groupBy("bucket").agg(F.expr("bitmap_construct_agg(position)").alias("bits")).toLocalIterator():
        out[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def in_filter(bitmap: np.ndarray, node: int) -> bool:
    """The built-in bitmaps count from 1; bit 0 has no place in them and always lets through."""
    b = node % FILTER_BITS - 1
    return b < 0 or bool(bitmap[b // 8] >> (b % 8) & 1)


def sets_of(docs: DataFrame, bitmap, width: int) -> DataFrame:
    """(node, hashes) of the sets that the filter lets through. docs: key, text."""

    def run(batches):
        seen = set()

        def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
            nodes, sets = [], []
            for text in texts(batch):
                h = shingle_set(text, width)
                if len(h) and (node := set_id(h)) not in seen and in_filter(bitmap.value, node):
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(node)
                    nodes.append(node)
                    sets.append(h.view(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "hashes"])

        yield from per_slice(rows)(batches)

    return docs.select("text").mapInArrow(run, "node bigint, hashes array<bigint>")


class Joined:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def union(self, i: int, j: int) -> None:
        self.up[self.find(i)] = self.find(j)


def wide_sketch(h: np.ndarray) -> np.ndarray:
    """Parities of SKETCH_BITS bits, as 64-bit words."""
    return np.packbits((np.bincount((mixed(h) % U(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)).view(U)


def links(nodes: list[int], sets: list[np.ndarray], sides: np.ndarray, bands: Bands) -> list[tuple[int, int]]:
    """Links that join the sets of one family; sides: 0 and 1 where only sets of different sides are to be compared, else all 2."""
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    nodes, sets, sizes, sides = [nodes[i] for i in order], [sets[i] for i in order], sizes[order], sides[order]
    sketches = np.stack([wide_sketch(s) for s in sets])
    joined, out = Joined(len(nodes)), []
    roots = np.arange(len(nodes))
    for i in range(len(nodes) - 1):
        stop = int(np.searchsorted(sizes, sizes[i] * bands.den // bands.num, side="right"))
        if stop <= i + 1:
            continue
        near = np.bitwise_count(sketches[i + 1 : stop] ^ sketches[i]).sum(axis=1) <= bands.most_apart(sizes[i], sizes[i + 1 : stop])
        if sides[i] != 2:
            near &= sides[i + 1 : stop] != sides[i]
        for j in (np.flatnonzero(near) + i + 1).tolist():
            if joined.find(i) == joined.find(j):
                continue
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if bands.den * common >= bands.num * (len(sets[i]) + len(sets[j]) - common):
                joined.union(i, j)
                out.append((nodes[i], nodes[j]))
    return out


def in_blocks(found: DataFrame, sizes: DataFrame) -> DataFrame:
    """(node, component, n, block) of the sets of families; block: null in a family of one block, else from 0 by the sets' sizes. found: node, component; sizes: node, n.

    A family is cut where the sets of each size are counted, and the sets of a cut size are dealt by hash, so no task sees a whole family.
    """
    whole = found.unionByName(found.select(F.col("component").alias("node"), "component").distinct()).join(sizes, "node")
    counts = whole.groupBy("component", "n").agg((F.count("*") * (1 / F.lit(float(BLOCK)) + F.col("n") / F.lit(float(BLOCK_SHINGLES)))).alias("part"))
    family = Window.partitionBy("component")
    cuts = counts.select("component", "n", "part", F.sum("part").over(family).alias("all"), (F.sum("part").over(family.orderBy("n")) - F.col("part")).alias("before"))
    share = F.pmod(F.xxhash64("node"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    block = F.when(F.col("all") > 1, F.floor(F.col("before") + share * F.col("part")).cast("int"))
    return whole.join(cuts, ["component", "n"]).select("node", "component", "n", block.alias("block"))


def block_pairs(placed: DataFrame, num: int, den: int) -> DataFrame:
    """(component, block, a, b, side, shingles): for each pair of a family's blocks (a <= b) whose sizes admit a link, a row a block; side: 0 and 1, or 2 where a = b."""
    blocks = placed.where("block is not null").groupBy("component", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.sum("n").alias("shingles"))
    a, b = blocks.alias("a"), blocks.alias("b")
    pairs = a.join(b, (F.col("a.component") == F.col("b.component")) & (F.col("a.block") <= F.col("b.block")) & (F.col("b.lo") * num <= F.col("a.hi") * den))
    side = lambda x, i: F.struct(F.col(f"{x}.block").alias("block"), F.lit(i).alias("side"), F.col(f"{x}.shingles").alias("shingles"))
    sides = F.when(F.col("a.block") == F.col("b.block"), F.array(side("a", 2))).otherwise(F.array(side("a", 0), side("b", 1)))
    return pairs.select(F.col("a.component").alias("component"), F.col("a.block").alias("a"), F.col("b.block").alias("b"), F.explode(sides).alias("x")).select("component", "x.block", "a", "b", "x.side", "x.shingles")


def verified(found: DataFrame, sizes: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(u, v): a spanning forest of the links. found: node, component; sizes: node, n; sets: node, hashes.

    Families of many blocks are compared in passes, each of about as many shingles as all the sets have, and its links
    are written: the sets of a block are needed for each block that it meets, but never lie on the disk for all of them.
    """
    placed = materialize(in_blocks(found, sizes), "placed")
    pairs = materialize(block_pairs(placed, num, den), "blocks")
    rows = materialize(placed.join(sets, "node").select("node", "component", "block", "hashes"), "families")
    all_sets = placed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("block").isNull()).alias("small")).first()
    moved = pairs.agg(F.count("*").alias("rows"), F.coalesce(F.sum("shingles"), F.lit(0)).alias("n")).first()
    groups, passes = max(1, -(-all_sets.small // TOGETHER)), -(-moved.n // max(all_sets.n, LEAST_PASS))
    forget(placed)

    def compare(table: pa.Table) -> pa.Table:
        bands, out = Bands(num, den), []
        by: dict[int, dict[int, tuple]] = {}
        hashes = table.column("hashes").combine_chunks()
        flat, offsets = hashes.flatten().to_numpy().view(U), hashes.offsets.to_numpy() - hashes.offsets[0].as_py()
        for i, (family, node, side) in enumerate(zip(*(table.column(c).to_pylist() for c in ("component", "node", "side")))):
            by.setdefault(family, {})[node] = (flat[offsets[i] : offsets[i + 1]], side)
        for own in by.values():
            if len(own) > 1:
                out += links(list(own), [x[0] for x in own.values()], np.array([x[1] for x in own.values()]), bands)
        return pa.table({"u": pa.array([x[0] for x in out], pa.int64()), "v": pa.array([x[1] for x in out], pa.int64())})

    small = rows.where("block is null").select("node", "component", "hashes", F.pmod(F.xxhash64("component"), F.lit(groups)).alias("task"), F.lit(2).alias("side"))
    out = [materialize(small.groupBy("task").applyInArrow(compare, "u bigint, v bigint"), "links")]
    few = pairs.drop("shingles")
    for i in range(passes):
        now = few.where(F.pmod(F.xxhash64("component", "a", "b"), F.lit(passes)) == i)
        met = rows.where("block is not null").join(F.broadcast(now) if moved.rows <= BROADCAST_ROWS else now, ["component", "block"])
        out.append(materialize(met.select("node", "component", "hashes", "a", "b", "side").groupBy("component", "a", "b").applyInArrow(compare, "u bigint, v bigint"), "links"))
    forget(pairs, rows)
    return reduce(DataFrame.unionByName, out)


def join_similar(docs: DataFrame, width: int, num: int, den: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, n_shingles, component_id (the least key reachable by links of similarity num / den or more)."""
    df = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
    with_keys = materialize(fingerprints(df, width, num, den), "prints")
    shared = [stars(with_keys, part) for part in PART_NAMES]
    prints = materialize(with_keys.drop(*PART_NAMES), "nodes")
    forget(with_keys)  # the keys are the largest table here
    found = components(reduce(DataFrame.unionByName, shared))  # families
    forget(*shared)
    bitmap = docs.sparkSession.sparkContext.broadcast(node_filter(found.select("node").union(found.select("component").distinct())))  # FILTER_BITS, whatever the input
    sizes = prints.where("node is not null").groupBy("node").agg(F.max("n").alias("n"))
    joined = components(verified(found, sizes, sets_of(df, bitmap, width), num, den))
    forget(found)
    return labelled(prints, joined, key)


def labelled(prints: DataFrame, joined: DataFrame, key: str) -> DataFrame:
    """Components of documents from those of sets."""
    some = joined.select("node", "component").unionByName(joined.select(F.col("component").alias("node"), "component").distinct())
    by_node = prints.where("node is not null").groupBy("node").agg(F.min("key").alias("least"), F.count("*").alias("copies"))
    classes = by_node.join(some, "node", "left").withColumn("component", F.coalesce("component", "node"))
    own = classes.groupBy("component").agg(F.min("least").alias("component_id"), F.sum("copies").alias("members"))
    more = classes.join(own.where("members > 1"), "component").select("node", "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    rows = prints.select("key", "n", "node", F.pmod(F.xxhash64("key"), F.lit(SALT)).cast("int").alias("salt")).join(more, ["node", "salt"], "left")
    return rows.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id"))


def keep_one(docs: DataFrame, keep: tuple[str, ...], width: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (columns `keep`) of each component: that of the least key, a null key last; of one key, that whose text has the least hash.

    Rows equal in key and text are one row, whatever their other columns hold and empty or null as the text may be;
    other rows without shingles stay. Texts of one key are told apart by 128 bits.
    """
    body = docs[text].cast("string")
    own = F.struct(docs[key].isNull().alias("late"), docs[key].alias("key"), F.xxhash64(body).alias("a"), F.xxhash64(F.lit(1), body).alias("b"))
    groups = join_similar(docs.select(own.alias("own"), body.alias("text")), width, num, den, "own", "text")
    later = groups.where(F.col("component_id") != F.col("own")).select("own").distinct()
    rows = docs.select(own.alias("own"), F.struct(*(docs[c].alias(c) for c in keep)).alias("row"))
    kept = rows.join(later, "own", "left_anti")
    twice = materialize(rows.groupBy("own").agg(F.count("*").alias("n")).where("n > 1").select("own"), "twice")
    if not twice.isEmpty():
        kept = kept.join(twice, "own", "left_anti").unionByName(kept.join(twice, "own", "left_semi").dropDuplicates(["own"]))
    return kept.select("row.*")
