import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeveil.llm import lattice, maxscore, queries, token_counts

from . import cases


def vectors(spark, rows):
    return spark.createDataFrame([(k, v, 1, "a", 2) for k, v in rows], "vec_id bigint, embedding array<float>, label int, key string, x int")


def brute_top(rows, k, queries_at=50, scale=256):
    valid = []
    for key, v in rows:
        if key is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            valid.append((key, [math.floor(float(np.float32(x)) * scale) for x in v]))
    out = []
    for q in {key for key, _ in valid if key % queries_at == 0}:
        scores = sorted((-sum(a * b for a, b in zip(own, v)), key) for one, own in valid if one == q for key, v in valid if key != q)[:k]
        out += [(q, i + 1, key, max(-(2**63), min(2**63 - 1, -s))) for i, (s, key) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(2048, 8192), (2, 37)])
def test_top_k_against_all_scores(spark, blocks):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(64)]) for i in range(260)]
    rows += [(1000 + i, rows[50][1]) for i in range(9)]  # ties
    rows += [(300, None), (350, [1.0, None]), (400, [float("nan")] * 64), (450, [float("inf")] * 64), (500, []), (None, rows[3][1]), (550, [0.5] * 3), (7, rows[8][1]), (0, rows[0][1])]
    got = maxscore.top_k(vectors(spark, rows), F.col("key") % 50 == 0, 5, scale=256.0, queries_a_block=blocks[0], rows_a_block=blocks[1])
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 5)


def test_rows_of_one_key_are_all_kept(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.0]), (2, [0.25, 9.0])]
    got = maxscore.top_k(vectors(spark, rows), F.col("key") == 1, 5, scale=256.0)
    assert [(r.rank, r.vec_id, r.score) for r in got.orderBy("rank").collect()] == [(1, 2, 32768), (2, 2, 32768), (3, 2, 16384), (4, 2, 16384)]


def test_top_k_of_large_numbers_few_rows_and_none(spark):
    rows = [(0, [3e9, -3e9]), (1, [2e9, 1e9]), (2, [3e38, 3e38])]
    small = [r for r in rows if r[0] < 2]
    for table in (small, rows[:1], []):
        got = maxscore.top_k(vectors(spark, table), F.col("key") % 50 == 0, 5, scale=256.0)
        assert sorted(map(tuple, got.collect())) == brute_top(table, 5)
    assert maxscore.top_k(vectors(spark, rows), F.col("key") == 2, 1).first().score == 2**63 - 1


def test_terms_that_cannot_matter_are_left_out():
    rng = np.random.default_rng(0)
    x = rng.integers(-3, 4, (6000, 40)).astype(np.float64)
    x[:, :3] *= 100
    q = np.ones(40)
    want = sorted((-int(s), int(k)) for s, k in zip(x @ q, range(6000)))[:5]
    got = maxscore.search(q, -1, x, np.arange(6000), x.min(axis=0), x.max(axis=0), 5)
    assert got == [(k, -s) for s, k in want]


WEIGHTS = [("▁", 0.0), ("▁a", -1.0), ("a", -2.0), ("b", -3.0), ("ab", -4.0), ("▁ab", -5.0), ("bb", -6.0)]


def brute_marginal(model, weights, word):
    """Sum over all segmentations, one after the other."""
    text, unknown, stop, weights = "▁" + word, weights.unknown, weights.stop, dict(weights.pieces)

    def paths(i):
        if i == len(text):
            yield 1.0
        for j in range(i + 1, len(text) + 1):
            piece = text[i:j]
            w = weights.get(piece)
            if w is None and j == i + 1 and piece not in weights:
                w = math.log(unknown) - 8 * len(piece.encode()) * math.log(2)
            if w is not None:
                for p in paths(j):
                    yield p * math.exp(w) * (1 - stop)
        return

    return sum(paths(0)) * stop / (1 - stop) * (1 - lattice.END_SHARE)


def test_lattice_sums_all_segmentations():
    weights = lattice.piece_weights(WEIGHTS)
    model = lattice.Lattice(weights)
    for word in ("a", "ab", "abab", "bbab", "aéb", "zz", "abbbabba"):
        assert math.isclose(model.log_marginal(word), math.log(brute_marginal(model, weights, word)), rel_tol=1e-9)
    assert math.isfinite(model.log_marginal("x" * 30_000))
    assert math.isclose(sum(math.exp(w) for _, w in weights.pieces) + weights.unknown, 1)


def brute_expected(weights, words):
    """Expected counts by listing all segmentations."""
    known, found = dict(weights.pieces), {}
    number = {p: i for i, (p, _) in enumerate(weights.pieces)}

    def paths(text):
        if not text:
            yield 1.0, []
        for j in range(1, len(text) + 1):
            piece = text[:j]
            w = known.get(piece, math.log(weights.unknown) - 8 * len(piece.encode()) * math.log(2) if j == 1 else None)
            if w is not None:
                for p, rest in paths(text[j:]):
                    yield p * math.exp(w) * (1 - weights.stop), [number.get(piece, lattice.NO_PIECE), *rest]

    for word in words:
        every = list(paths("▁" + word))
        total = sum(p for p, _ in every)
        for p, pieces in every:
            for x in pieces:
                found[x] = found.get(x, 0.0) + p / total
    return {**found, lattice.WORDS: len(words)}


def test_weights_are_learned_by_expected_counts(spark):
    words, first = ["a", "ab", "abab", "bbab", "aéb", "zz", "abbbabba"], lattice.piece_weights(WEIGHTS)
    weights = first
    for _ in range(lattice.ROUNDS):
        weights = lattice.learned(first, brute_expected(weights, words))
    rows = [(w.encode(), 1 + i) for i, w in enumerate(words)] + [(b"", 9), (b"bbbb", 0)]  # the end token and a word of held-out texts don't count
    got = lattice.learn(spark.createDataFrame(rows, "word binary, c bigint"), WEIGHTS)
    assert [p for p, _ in got.pieces] == [p for p, _ in weights.pieces]
    for (_, a), (_, b) in zip(got.pieces, weights.pieces):
        assert math.isclose(a, b, rel_tol=1e-9)
    assert math.isclose(got.unknown, weights.unknown, rel_tol=1e-9) and math.isclose(got.stop, weights.stop, rel_tol=1e-9)
    assert math.isclose(sum(math.exp(w) for _, w in got.pieces) + got.unknown, 1)
    none = lattice.learn(spark.createDataFrame([], "word binary, c bigint"), WEIGHTS)
    assert all(math.isclose(a, b) for (_, a), (_, b) in zip(none.pieces, first.pieces)) and math.isclose(none.stop, first.stop)


def test_a_long_word_is_learned_in_stretches():
    model, found = lattice.Lattice(lattice.piece_weights(WEIGHTS)), defaultdict(float)
    model.expect("ab" * 10_000, found)
    assert math.isclose(sum(n * len(WEIGHTS[i][0]) for i, n in found.items() if i >= 0), 20_001, rel_tol=1e-9)
    assert found[lattice.WORDS] == 1


def test_short_words_need_no_logarithms(monkeypatch):
    rng, model = random.Random(5), lattice.Lattice(lattice.piece_weights(WEIGHTS))
    words = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, lattice.SHORT))) for _ in range(60)]

    def read(word):
        found = defaultdict(float)
        model.expect(word, found)
        return {k: n for k, n in found.items() if n}, model.log_marginal(word)

    monkeypatch.setattr(lattice, "SHORT", 0)
    want = [read(w) for w in words]
    odd = [read(w) for w in ("é" * 30, "aé" * 9, "ab" * 40)]
    monkeypatch.undo()
    assert [read(w) for w in ("é" * 30, "aé" * 9, "ab" * 40)] == odd
    monkeypatch.setattr(lattice.Lattice, "arcs", None)
    for word, (found, marginal) in zip(words, want):
        counts, log = read(word)
        assert counts == pytest.approx(found, rel=1e-9) and log == pytest.approx(marginal, rel=1e-12)


@pytest.mark.parametrize("hot", [lattice.HOT, 3])
def test_scores_of_texts(spark, hot):
    rows = cases.awkward()
    docs = cases.documents(spark, rows)
    got = lattice.score_texts(docs, WEIGHTS, queries.fold(docs["doc_id"]) == 1, hot=hot).collect()
    assert len(got) == len(rows)
    want, counts = cases.brute_base([r for r in rows]), {}
    for key, t in rows:
        if key is None or not cases.held(key, 1):
            for w in [*cases.words(t), ""]:
                counts[w] = counts.get(w, 0) + 1
    weights = first = lattice.piece_weights(WEIGHTS)
    for _ in range(lattice.ROUNDS):
        found = defaultdict(float)
        for w in counts:
            if w:
                lattice.Lattice(weights).expect(w, found)
        weights = lattice.learned(first, found)
    model = lattice.Lattice(weights)
    mass, n = max(1, sum(c == 1 for c in counts.values())), sum(counts.values())
    texts = {}
    for key, t in rows:
        texts.setdefault(key, []).append(t)
    for r in got:
        if r.doc_id is None:
            continue
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert math.isclose(r.base_score, want[r.doc_id][4], rel_tol=1e-9)
        own = [*cases.words(texts[r.doc_id][0]), ""]
        if len(own) < 500 and all(len(w) < 100 for w in own):
            score = sum(math.log10((counts.get(w, 0) + mass * math.exp(model.log_marginal(w))) / (n + mass)) for w in own)
            assert math.isclose(r.score, score, rel_tol=1e-9)
        assert r.score < 0 and math.isfinite(r.score)


def test_scores_of_no_texts(spark):
    docs = cases.documents(spark, [])
    assert lattice.score_texts(docs, WEIGHTS, queries.fold(docs["doc_id"]) == 1).collect() == []


def test_training_makes_held_out_texts_likelier(spark, small_dir):
    """Against the same model without counts: the lattice alone."""
    got = queries.op2_lm_score(spark, small_dir).where("held_out").collect()
    model = lattice.Lattice(lattice.piece_weights(token_counts.unigram_vocabulary(cases.vocabulary_file("piece_bpe_32k.model"))))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    alone = sum(sum(model.log_marginal(w) for w in [*cases.words(texts[r.doc_id]), ""]) / math.log(10) for r in got)
    assert sum(r.score for r in got) > alone


def test_token_counts_are_the_tokenizers(spark, small_dir):
    from tokenizers import Tokenizer, models

    vocabulary = token_counts.unigram_vocabulary(cases.vocabulary_file("piece_bpe_32k.model"))
    byte_pieces = [(f"<0x{i:02X}>", -1e12) for i in range(256)]
    exact = Tokenizer(models.Unigram([("<unk>", 0.0), *byte_pieces, *vocabulary], 0, True))
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()]
    rows += [(9000 + i, t) for i, (_, t) in enumerate(cases.awkward()) if t is None or len(t) < 3000] + [(9999, "a  b   c\n\n d\t😀😀 e ")]
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(cases.documents(spark, rows), vocabulary).collect()}
    assert len(got) == len({k for k, _ in rows})
    for key, t in rows:
        assert got[key] == (len(exact.encode("▁" + t.replace(" ", "▁"), add_special_tokens=False).ids) if t else 0), key


def test_ties_go_to_the_piece_that_starts_first():
    model = token_counts.Viterbi([("a", -2.0), ("aa", -4.0), ("aaa", -6.0), ("▁", -1.0), ("b", -3.0)])
    assert model.count("aaa") == (2, -7.0)  # the mark, then aaa; not a + aa, aa + a or a + a + a
    assert model.count("aaab") == (3, -10.0)
    assert model.count("") == (0, 0.0)
    assert model.count("a" * 200_001) == (66_668, -400_003.0)  # a word far longer than any piece
    assert model.best("é") == (2, -16.0)


def test_token_counts_of_no_texts(spark):
    assert token_counts.count_tokens(cases.documents(spark, []), WEIGHTS).collect() == []
