import corpus_pipeline
from lakeveil.llm import queries
from lakeveil.llm.shared import materialize

from . import cases
from .test_duplicates import brute_hits, brute_lines
from .test_packing import best_fit, checked


def test_each_stage_on_its_own_input(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    inputs, tables = [], []
    for name, stage in corpus_pipeline.STAGES:
        inputs.append([(r.doc_id, r.text) for r in docs.collect()])
        docs = materialize(stage(spark, docs, small_dir), name)
        tables.append(docs)
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = [[(r.doc_id, r.text) for r in t.collect()] for t in tables[:-1]]

    good = {r.doc_id for r in queries.op3_quality(spark, small_dir).collect() if r.predicted}
    assert sorted(kept[0]) == sorted(x for x in inputs[0] if x[0] in good)

    lines = [(k, t) for (k, t), (_, was) in zip(sorted(brute_lines(inputs[1])), sorted(inputs[1])) if t == was or t.strip()]
    assert sorted(kept[1]) == sorted(lines)
    assert all(r.n_chars == len(r.text) for r in tables[1].collect())

    least = [(k, t) for (k, t), (_, _, c) in zip(inputs[2], cases.brute_components(inputs[2], 5, 80, 100)) if c == k]
    assert sorted(kept[2]) == sorted(least)

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").collect()]
    assert sorted(kept[3]) == sorted((k, t) for k, t in inputs[3] if not brute_hits(t, items)[1])

    with open(cases.vocabulary_file("word_bpe_49k.json"), encoding="utf-8") as f:
        packed = tables[4].collect()
        assert checked(inputs[4], packed, f.read()) == best_fit([r.length for r in packed], 2048)
    assert len(kept[3]) < len(inputs[0])


def test_run_gives_the_last_stage(spark, small_dir):
    assert corpus_pipeline.run(spark, small_dir).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_a_document_with_a_line_left_stays(spark):
    same = "one two three four five six seven"
    rows = [(1, f"{same}\nown words"), (2, f"{same}\nshort\nlines, too"), (3, same), (4, f"{same}\n \t\n"), (5, "x"), (6, " ")]
    kept = corpus_pipeline.line_repeats(spark, cases.documents(spark, rows), "").collect()
    assert sorted((r.doc_id, r.text, r.n_chars) for r in kept) == [(1, f"{same}\nown words", 43), (2, "short\nlines, too", 16), (5, "x", 1), (6, " ", 1)]


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def test_awkward_rows_through_every_stage(spark, small_dir):
    """Nulls, empty and long texts, repeated rows, null keys and extra columns with clashing names."""
    rows = cases.awkward(seed=4)
    docs = materialize(cases.documents(spark, rows), "awkward")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, small_dir)
    assert set(rows_of(good)) <= set(rows) and good.columns == list(corpus_pipeline.COLUMNS)

    lines = materialize(stages["line_dedup"](spark, docs, small_dir), "lines")
    once = list(dict.fromkeys(rows))
    cut = dict(zip(once, brute_lines(once)))  # repeated rows are at one place and fare alike
    want = [cut[x] for x in rows if cut[x] == x or (cut[x][1] or "").strip()]
    assert sorted(map(repr, rows_of(lines))) == sorted(map(repr, want))

    one = materialize(stages["ngram_join"](spark, docs, small_dir), "one")
    assert sorted(map(repr, rows_of(one))) == sorted(repr(x) for x, (_, _, c) in zip(once, cases.brute_components(once, 5, 80, 100)) if c == x[0])

    clean = materialize(stages["decontamination"](spark, one, small_dir), "clean")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").collect()]
    assert sorted(map(repr, rows_of(clean))) == sorted(repr(x) for x in rows_of(one) if not brute_hits(x[1] or "", items)[1])

    packed = stages["packing"](spark, clean, small_dir).collect()
    assert sorted(repr(r.doc_id) for r in packed if r.piece == 0) == sorted(repr(k) for k, _ in rows_of(clean))


def test_no_rows_through_every_stage(spark, small_dir):
    docs = cases.documents(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, small_dir), name)
        assert docs.collect() == []
