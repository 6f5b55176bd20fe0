"""Small tables with every awkward case, and brute-force versions of the operators."""

import math
import random
import re
import zlib
from collections import Counter

import public_tokenizers

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Columns with names that the operators use inside.
EXTRA = "key string, row int, n int, word string, node int, keys int, task int, length int, start int, x int, component string, hits int, score string, line string, id int, words_text string, spans int"
SCHEMA = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {EXTRA}"
N_EXTRA = len(EXTRA.split(","))


def documents(spark, rows):
    """rows: (doc_id, text)."""
    full = [(i, t, "en", "s", len(t) if t is not None else None, *("0" if " string" in c else 0 for c in EXTRA.split(","))) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(rng, n, words=400):
    return " ".join(f"w{min(int(rng.expovariate(1 / 60)), words)}" for _ in range(n))


def awkward(seed=0, n=60):
    """Prose with near copies, and nulls, empty, blank, long, repeated and equal texts, and null keys."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if i % 3 == 2:  # a near copy of an earlier text
            words = rows[rng.randrange(len(rows))][1].split(" ")
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = f"new{rng.randrange(1000)}"
            rows.append((i, " ".join(words)))
        else:
            rows.append((i, prose(rng, rng.choice((1, 2, 3, 5, 20, 60, 150)))))
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one"), (1004, "One"), (1005, "two words"), (1006, prose(rng, 20_000)), (1007, "x" * 30_000), (1008, "é ß ﬁ \u2003 İ😀"), (None, rows[0][1]), (None, None)]
    rows += [rows[5], rows[5], (1001, "")]  # repeated rows
    return rows


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text, width):
    w = words(text)
    return frozenset(tuple(w[i : i + min(width, len(w))]) for i in range(len(w) - min(width, len(w)) + 1)) if w else frozenset()


def linked(a, b, num, den):
    common = len(a & b)
    return bool(a) and bool(b) and den * common >= num * (len(a) + len(b) - common)


def brute_components(rows, width, num, den):
    """(doc_id, size, component) of each row, in order."""
    sets = [shingles(t, width) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if linked(sets[i], sets[j], num, den):
                up[find(i)] = find(j)
    out = []
    for i, (key, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((key, len(sets[i]), min(ids) if ids and sets[i] else key))
    return out


def held(key, rest):
    return zlib.crc32(str(key).encode()) % 5 == rest


def brute_base(rows):
    """doc_id -> (held_out, n_tokens, n_known, train_tokens, base_score) of distinct keys."""
    counts = Counter()
    for key, t in rows:
        if key is None or not held(key, 1):
            counts.update([*words(t), None])
    n, v = sum(counts.values()), len(counts)
    return {key: (key is not None and held(key, 1), len(words(t)) + 1, sum(counts[w] > 0 for w in [*words(t), None]), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*words(t), None])) for key, t in rows}


def vocabulary_file(name):
    return public_tokenizers.path(name)
