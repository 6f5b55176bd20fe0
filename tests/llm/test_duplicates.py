import random
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from lakeveil.llm import components, line_dedup, parity_join, queries, shared, winnowing

from . import cases


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(name, same_as_sql):
    same_as_sql(queries.QUERIES[name], queries.ORACLES[name])


@pytest.mark.parametrize(("width", "num"), [(3, 90), (5, 80), (3, 60)])
def test_components_against_all_pairs(spark, width, num):
    rows = cases.awkward(seed=num, n=120)
    got = parity_join.join_similar(cases.documents(spark, rows), width, num, 100).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, cases.brute_components(rows, width, num, 100)))


def family(n, seed=5):
    """Copies of one text with a few words changed each, so that many lie at the edge of the similarity."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randrange(1, 7)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("block", [1024, 16])
def test_a_large_family_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(parity_join, "BLOCK", block)
    rows = family(120) + [(1000 + i, family(1)[0][1]) for i in range(40)]
    got = parity_join.join_similar(cases.documents(spark, rows), 3, 90, 100).collect()
    assert sorted(map(tuple, got)) == sorted(cases.brute_components(rows, 3, 90, 100))


def test_linked_sets_share_a_key():
    rng = random.Random(6)
    for num in (90, 80):
        bands = parity_join.Bands(num, 100)
        for _ in range(1500):
            n = rng.choice((2, 5, 9, 12, 20, 50, 120, 400))
            a = np.unique(np.array([rng.getrandbits(64) for _ in range(n)], np.uint64))
            apart = bands.most_apart(n, n)
            drop, add = (rng.randrange(apart + 1) for _ in range(2))
            b = np.unique(np.concatenate([a[rng.randrange(1) + min(drop, n - 1) :], np.array([rng.getrandbits(64) for _ in range(add)], np.uint64)]))
            common = len(np.intersect1d(a, b))
            if 100 * common >= num * (len(a) + len(b) - common) and not np.array_equal(a, b):
                assert set(bands.keys(a).tolist()) & set(bands.keys(b).tolist())


def test_sketch_distance_is_a_lower_bound():
    rng = random.Random(7)
    for _ in range(200):
        a, b = (np.unique(np.array([rng.randrange(400) for _ in range(rng.randrange(1, 300))], np.uint64)) for _ in range(2))
        assert int(np.bitwise_count(parity_join.wide_sketch(a) ^ parity_join.wide_sketch(b)).sum()) <= len(np.setxor1d(a, b))


def test_filter_never_loses_a_node(spark):
    rng = random.Random(8)
    nodes = [rng.getrandbits(64) - 2**63 for _ in range(500)] + [0, 1, -1, parity_join.FILTER_BITS, parity_join.FILTER_BITS - 1, 32768, 32767]
    bitmap = parity_join.node_filter(spark.createDataFrame([(n,) for n in nodes], "node bigint"))
    assert all(parity_join.in_filter(bitmap, n) for n in nodes)
    assert sum(parity_join.in_filter(bitmap, rng.getrandbits(64) - 2**63) for _ in range(2000)) < 5


def test_no_documents_to_join(spark):
    assert parity_join.join_similar(cases.documents(spark, []), 3, 90, 100).collect() == []


def test_one_of_each_group_stays(spark):
    rows = cases.awkward(seed=9, n=90)
    docs = cases.documents(spark, rows)
    kept = parity_join.keep_one(docs, tuple(docs.columns))
    assert kept.columns == docs.columns
    rows = list(dict.fromkeys(rows))  # repeated rows are one
    want = [(k, t) for (k, t), (_, _, c) in zip(rows, cases.brute_components(rows, 5, 80, 100)) if c == k]
    assert sorted(map(repr, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(repr, want))


def test_rows_of_one_key_and_of_none(spark):
    same = "a b c d e f g"
    rows = [(1, same), (1, same), (1, "other words entirely, not like it at all"), (None, same), (None, "x y"), (None, "x y"), (None, None), (None, None), (2, ""), (2, ""), (3, None), (4, "u v w x y z"), (4, "U V w x y z")]
    kept = sorted(map(repr, ((r.doc_id, r.text) for r in parity_join.keep_one(cases.documents(spark, rows), ("doc_id", "text")).collect())))
    four = [r for r in kept if r.startswith("(4,")]
    assert len(four) == 1
    assert [r for r in kept if r not in four] == sorted(map(repr, [(1, same), (1, rows[2][1]), (None, "x y"), (None, None), (2, ""), (3, None)]))


def test_components_of_paths_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()))
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)}, 201: 200}
    assert components.components(spark.createDataFrame([], "u bigint, v bigint")).collect() == []


def line_set(line):
    """The five-word shingles of a line; all its words, if there are fewer."""
    w = line.split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def brute_lines(rows):
    """Texts without lines that an earlier line matches."""
    lines = [(k, no, line_set(x)) for k, t in rows if k is not None and t is not None for no, x in enumerate(t.split("\n"))]
    lines.sort(key=lambda x: x[:2])
    gone = {(k, no) for i, (k, no, s) in enumerate(lines) if any(cases.linked(s, o, 80, 100) for *_, o in lines[:i])}
    return [(k, t if k is None or t is None else "\n".join(x for no, x in enumerate(t.split("\n")) if (k, no) not in gone)) for k, t in rows]


def lined(seed, n=50):
    rng = random.Random(seed)
    pool = [cases.prose(rng, rng.choice((5, 6, 9, 30, 70))) for _ in range(25)]
    rows = []
    for i in range(n):
        lines = []
        for _ in range(rng.randrange(1, 8)):
            words = rng.choice(pool).split(" ")
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = f"n{rng.randrange(50)}"
            lines.append(rng.choice((" ".join(words), "short line", "", "  ", "a  b " * 3)))
        rows.append((i, "\n".join(lines)))
    long = "\n".join(cases.prose(rng, 12) for _ in range(800))
    return rows + [(1000, None), (1001, ""), (1002, "\n\n"), (1003, long), (1004, long), (None, rows[0][1]), (1005, "é ß ñ ü ö ä\n" * 3), (1006, "w" * 20_000 + " a b c d e")]


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_against_all_pairs(spark, seed):
    rows = lined(seed)
    docs = cases.documents(spark, rows)
    got = line_dedup.dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    found = got.collect()
    assert sorted(map(repr, ((r.doc_id, r.text) for r in found))) == sorted(map(repr, brute_lines(rows)))
    for r, (_, t) in zip(sorted((r for r in found if r.doc_id is not None), key=lambda r: r.doc_id), sorted((x for x in rows if x[0] is not None))):
        assert r.n_lines == (len(t.split("\n")) if t else 0)


@pytest.mark.parametrize("samples", [(), (1, 3)])
def test_lines_joined_by_shuffle_and_in_rounds(spark, monkeypatch, samples):
    monkeypatch.setattr(line_dedup, "SAMPLES", samples)
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    rows = lined(3, 20)
    assert sorted(map(repr, ((r.doc_id, r.text) for r in line_dedup.dedup_lines(cases.documents(spark, rows)).collect()))) == sorted(map(repr, brute_lines(rows)))


def test_lines_of_a_large_family(spark):
    rows = [(i, "\n".join(t for _, t in family(3, seed=i))) for i in range(60)]  # each line differs from most others by about the limit
    got = line_dedup.dedup_lines(cases.documents(spark, rows)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted(brute_lines(rows))


def test_lines_of_nothing_and_of_repeated_rows(spark):
    assert line_dedup.dedup_lines(cases.documents(spark, [])).collect() == []
    same = [(1, "a b c d e f\na b c d e f"), (1, "a b c d e f\na b c d e f")]
    assert [r.text for r in line_dedup.dedup_lines(cases.documents(spark, same)).collect()] == ["a b c d e f"] * 2


def test_short_lines_and_all_white_space(spark):
    rows = [(1, "two words\none\n\nset in tabs\tby\tthe\tdozen"), (2, "two  words\nTwo words\none\r\n \t\n"), (3, "set in tabs by the dozen\ntwo\twords\n一二三四五六七八九十"), (4, "一二三四五六七八九十\nfour words are here\nfour words are")]
    rows += [(10 + k, t) for k, t in lined(4, 30) if k is not None]
    got = line_dedup.dedup_lines(cases.documents(spark, rows)).collect()
    assert sorted(map(repr, ((r.doc_id, r.text) for r in got))) == sorted(map(repr, brute_lines(rows)))
    kept = {r.doc_id: r.text for r in got}
    assert [kept[k] for k in (2, 3, 4)] == ["Two words\n \t\n", "一二三四五六七八九十", "four words are here\nfour words are"]


def test_line_dedup_runs_no_python(spark, small_dir):
    plan = queries.op7_line_dedup(spark, small_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def brute_hits(doc, items, window=10):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (doc or "").translate(cases.LOWER))
    hit, found = set(), set()
    for key, t in items:
        x = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(cases.LOWER))
        n = min(window, len(x))
        grams = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n and key is not None else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(str(key))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block_words", [winnowing.BLOCK_WORDS, 60])
def test_overlaps_against_all_windows(spark, block_words):
    rng = random.Random(11)
    items = [(i, cases.prose(rng, rng.choice((1, 3, 9, 10, 11, 30, 60)), 40)) for i in range(20)] + [(20, None), (21, ""), (22, "!!"), (None, "w1"), (3, "aa bb cc")]
    rows = []
    for i in range(60):
        words = cases.prose(rng, 40, 40).split(" ")
        for _ in range(rng.randrange(3)):
            own = (rng.choice(items)[1] or "").split(" ")
            a = rng.randrange(len(own))
            at = rng.randrange(len(words))
            words[at:at] = own[a : a + rng.randrange(1, 40)]
        rows.append((i, ", ".join(words).upper() if i % 2 else "-".join(words)))
    rows += [(100, None), (101, ""), (102, "..."), (103, cases.prose(rng, 30_000, 40)), (None, rows[1][1]), rows[4]]
    bench = spark.createDataFrame([(k, t, "x", 1) for k, t in items], "item_id bigint, text string, key string, n_words int")
    got = winnowing.find_overlaps(cases.documents(spark, rows), bench, block_words=block_words).collect()
    out = [(r.doc_id, r.n_words, sum(h.end - h.start for h in r.hits), r["items"]) for r in got]
    assert sorted(map(repr, out)) == sorted(repr((k, *brute_hits(t, items))) for k, t in rows)


def test_overlaps_of_nothing(spark):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert winnowing.find_overlaps(cases.documents(spark, []), bench).collect() == []
    assert winnowing.find_overlaps(cases.documents(spark, [(1, "a b")]), bench).first().hits == []


def test_every_shared_window_has_a_fingerprint():
    rng = np.random.default_rng(12)
    for _ in range(300):
        span = rng.integers(1, 5, 10)
        a, b = (np.concatenate([rng.integers(1, 5, rng.integers(0, 30)), span, rng.integers(1, 5, rng.integers(0, 30))]) for _ in range(2))
        prints = [set(h[winnowing.fingerprints(h, 6)].tolist()) for h in (winnowing.gram_hashes(x, 5) for x in (a, b))]
        assert prints[0] & prints[1]


def test_sketch_keys_are_joined_in_parts(spark):
    """No join moves all keys at once, and the parts hold every key once."""
    import numpy as np

    rows = family(60)
    docs = cases.documents(spark, rows).selectExpr("doc_id as key", "text")
    prints = parity_join.fingerprints(docs.coalesce(1), 3, 90, 100).collect()
    bands, total = parity_join.Bands(90, 100), [0] * parity_join.PARTS
    for r in prints:
        parts = [r[c] for c in parity_join.PART_NAMES]
        whole = bands.keys(parity_join.shingle_set(dict(rows)[r.key].encode(), 3)).view(np.int64)
        assert sorted(k for part in parts for k in part) == sorted(whole.tolist())
        total = [n + len(part) for n, part in zip(total, parts)]
    assert max(total) < 0.4 * sum(total)


def sized_family(n):
    """Texts of one family, each with a copy near it, from 40 words to many: most of them are too far apart in size to link."""
    rng, words = random.Random(3), [f"w{i}" for i in range(40 + 12 * n)]
    rows = []
    for i in range(n):
        own = words[: 40 + 12 * i]
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join([*own[:-1], f"n{rng.randrange(10**6)}"]))]
    return rows


def test_blocks_meet_those_of_like_sizes_alone(spark, monkeypatch):
    monkeypatch.setattr(parity_join, "BLOCK", 4)
    sizes = [(i, 40 + 12 * i) for i in range(80)] + [(100, 60), (101, 60), (102, 9)]
    found = spark.createDataFrame([(i, 0) for i in range(1, 80)] + [(101, 100), (102, 100)], "node bigint, component bigint")
    placed = parity_join.in_blocks(found, spark.createDataFrame(sizes, "node bigint, n bigint")).localCheckpoint()
    of = {r.node: (r.component, r.block) for r in placed.collect()}
    assert len(of) == 83 and {of[i] for i in (100, 101, 102)} == {(100, None)}
    met = {(r.a, r.b) for r in parity_join.block_pairs(placed, 80, 100).collect()}
    assert all(tuple(sorted((of[i][1], of[j][1]))) in met for i, n in sizes[:80] for j, m in sizes[:80] if 80 * m <= 100 * n and 80 * n <= 100 * m)
    blocks = len({of[i] for i in range(80)})
    assert blocks >= 20 and len(met) < 0.6 * blocks * (blocks + 1) / 2


@pytest.mark.parametrize("least_pass", [parity_join.LEAST_PASS, 1])
def test_large_families_in_passes(spark, monkeypatch, least_pass):
    monkeypatch.setattr(parity_join, "BLOCK", 4)
    monkeypatch.setattr(parity_join, "LEAST_PASS", least_pass)
    rows = sized_family(30) + [(1000 + i, t) for i, t in family(30)]
    got = parity_join.join_similar(cases.documents(spark, rows), 3, 90, 100).collect()
    assert sorted(map(tuple, got)) == sorted(cases.brute_components(rows, 3, 90, 100))


def test_line_dedup_leaves_no_sets_behind(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(shared, "shared_dir", lambda spark: str(tmp_path))
    assert len(line_dedup.dedup_lines(cases.documents(spark, family(20))).collect()) == 20
    left = sorted(p.name.split("-")[1] for p in tmp_path.iterdir())
    assert left and not {"sets", "at", "prefixes", "lines"} & set(left)


def test_prefixes_sort_numbers_outside_of_lambdas(spark):
    """Within a lambda Spark sorts objects; the step before it sorts plain numbers."""
    docs = cases.documents(spark, family(3)).selectExpr("doc_id as key", "text")
    plan = line_dedup.prefixes(line_dedup.hashed(line_dedup.lines_of(docs)), line_dedup.rarity_levels(docs))._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(array(array_distinct(sort_array" not in plan
    assert "array_distinct(sort_array(start" in plan


def test_chosen_lines_alone_are_searched_for_white_space(spark):
    text = "a\tb\n\u2003c d\u00a0e\n\nf\u3000g é\n\x0bh"
    docs = spark.createDataFrame([(1, text), (2, "plain\nlines é")], "key bigint, text string")
    at = spark.createDataFrame([(1, [(0, 7, 70), (1, 8, 80), (3, 9, 90), (9, 10, 100)]), (2, [(1, 11, 110)])], "key bigint, places array<struct<no:int,ord:bigint,own:bigint>>")
    got = line_dedup.lines_at(docs, at)
    assert sorted(map(tuple, got.collect())) == [(0, 7, 70, "a b"), (1, 8, 80, " c d e"), (1, 11, 110, "lines é"), (3, 9, 90, "f g é")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "contains(cast(line" in plan and "contains(cast(text" not in plan


def test_order_of_tokens_takes_no_pass_over_the_texts(spark):
    unread = spark.range(1).select(F.raise_error(F.lit("the texts were read")).cast("string").alias("text"))
    line_dedup.rarity_levels(unread)


def test_prefixes_hold_the_first_tokens_of_sets(spark):
    """Also where first words repeat so often that twice as many don't suffice."""
    rng = random.Random(21)
    pool = ["a", "bb", "é", "dddd", "eeeeeeeeeeee", "f" * 40]
    rows = [(i, "\n".join(" ".join(rng.choices(pool[: rng.randrange(1, 7)], k=rng.randrange(1, 90))) for _ in range(3))) for i in range(60)]
    lines = line_dedup.hashed(line_dedup.lines_of(cases.documents(spark, rows).selectExpr("doc_id as key", "text")))
    own, tokens = [], {}
    for r in line_dedup.prefixes(lines).collect():
        if r.token is None:
            own.append((r.key, r.no))
        else:
            assert r.key is r.no is r.b is None
            tokens.setdefault(r.a, set()).add(r.token)
    assert sorted(own) == [(i, no) for i in range(60) for no in range(3)]
    for r in line_dedup.with_sets(lines.where("size(h) >= 5")).collect():
        assert r.tokens == sorted(set(r.tokens)) and set(r.tokens[: len(r.tokens) - -(-len(r.tokens) * 4 // 5) + 1]) <= tokens[r.id.a]


@pytest.mark.parametrize("few", [None, 0])
def test_documents_stay_where_few_lines_go(spark, monkeypatch, few):
    """The places of lines that go are broadcast if they are few, and else meet the documents by shuffle; lines repeat their shingles."""
    if few is not None:
        monkeypatch.setattr(line_dedup, "BROADCAST_TOKENS", few)
    rng, rows = random.Random(23), []
    for i in range(30):
        base = [f"w{rng.randrange(6)}x" for _ in range(rng.choice((6, 9, 14)))]
        words = base * rng.randrange(1, 12)
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(9)}"
        rows += [(i, "\n".join((" ".join(words), " ".join(base * 9), " ".join(base * 2 + words))))]
    want = sorted(brute_lines(rows))
    assert any(t != u for (_, t), (_, u) in zip(want, rows))
    got = line_dedup.dedup_lines(cases.documents(spark, rows))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ("ShuffledHashJoin" in plan, "BroadcastHashJoin" in plan) == ((True, False) if few == 0 else (False, True))
    assert sorted((r.doc_id, r.text) for r in got.collect()) == want
