import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lakeveil.llm import packing, queries

from . import cases


@pytest.fixture(scope="module")
def tokenizer_json():
    with open(cases.vocabulary_file("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def checked(rows, packed, tokenizer_json, capacity=2048):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_str(tokenizer_json)
    want = []
    for key, t in rows:
        ids = np.array([*exact.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(key, i, s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity].tobytes())) for i, s in enumerate(range(0, len(ids), capacity))]
    assert sorted(map(repr, ((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed))) == sorted(map(repr, want))
    sequences = defaultdict(list)
    for r in packed:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


def best_fit(lengths, capacity):
    """One piece after the other, longest first, into the fullest sequence that holds it."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        at = min((i for i, g in enumerate(gaps) if g >= n), key=lambda i: gaps[i], default=None)
        if at is None:
            gaps.append(capacity - n)
        else:
            gaps[at] -= n
    return len(gaps)


def test_pieces_ids_and_places(spark, small_dir, tokenizer_json):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()]
    rows += [(5000 + i, t) for i, (_, t) in enumerate(cases.awkward())] + [(None, "null key"), (8000, "a<|endoftext|>b <|startoftext|>"), (8001, "İΣΑΣ e\u0301 \u0301x\u00a0y\x1cz\r\nA'll"), (8002, "a " * 2046 + "a"), (8003, "a " * 2048)]
    packed = packing.pack(cases.documents(spark, rows), tokenizer_json).collect()
    n = checked(rows, packed, tokenizer_json)
    assert n == best_fit([r.length for r in packed], 2048)
    assert n <= 1.02 * sum(r.length for r in packed) / 2048 + 1


def test_ids_on_request_and_small_capacity(spark, tokenizer_json):
    rows = cases.awkward(n=12)
    packed = packing.pack(cases.documents(spark, rows), tokenizer_json, capacity=7, with_ids=True).collect()
    checked(rows, packed, tokenizer_json, 7)
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in packed)


def test_words_of_letters_and_other_files(tokenizer_json):
    import json

    rng = random.Random(4)
    alphabet = "abcdefgxyzéßñüöäàçœÿ÷×ABCÉ'’-.,;!?(){}<|>0123 \t\n\x0b\x1c\u00a0\u2003e\u0301中ﬁİ"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(4000)] + ["straße über, naïve; don't l'été x÷y a.b.c."]
    other = json.loads(tokenizer_json)
    other["normalizer"]["normalizers"] = other["normalizer"]["normalizers"][:2]  # keeps capitals
    for file in (tokenizer_json, json.dumps(other)):
        ids = packing.WordIds(file)
        assert ids.by_word == (file == tokenizer_json)
        assert ids.encode([t.encode() for t in texts]) == ids.exact(texts)


def test_no_documents(spark, tokenizer_json):
    assert packing.pack(cases.documents(spark, []), tokenizer_json).collect() == []


@pytest.mark.parametrize("capacity", [1, 10, 64])
def test_plan_is_best_fit(capacity):
    rng = random.Random(capacity)
    for _ in range(40):
        counts = {n: rng.randrange(1, 30) for n in rng.sample(range(1, capacity + 1), rng.randrange(1, min(capacity, 12) + 1))}
        fill = defaultdict(int)
        placed = defaultdict(list)
        for length, first, sequence, offset, n in packing.plan(counts, capacity).tolist():
            placed[length] += range(first, first + n)
            for s in range(sequence, sequence + n):
                fill[s] += length
        assert {k: sorted(v) for k, v in placed.items()} == {k: list(range(n)) for k, n in counts.items()}
        assert max(fill.values()) <= capacity
        assert len(fill) == best_fit([k for k, n in counts.items() for _ in range(n)], capacity)


def test_query_columns(spark, small_dir):
    assert queries.op5_packing(spark, small_dir).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
