import random
import re
import string

import pytest
from pyspark.sql import functions as F

from lakeveil.functions import text
from lakeveil.operators import detect, export, registry, review, spans, vault, verify
from lakeveil.plans import queries
from lakeveil.sources import dictionaries, pages


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


def values(spark, rows):
    return spark.createDataFrame(rows, "container string, page_no bigint, start bigint, entity_type string, value string")


def test_clean_form_against_python(spark):
    rng = random.Random(1)
    words = ["".join(rng.choices("aB é ß.,!-'\"\n\t\x0b\xa0 xY", k=rng.randrange(12))) for _ in range(300)]
    rows = spark.createDataFrame([(w,) for w in words], "x string").select("x", text.clean_form(F.col("x")).alias("y")).collect()
    for r in rows:
        assert r.y == " ".join(r.x.strip(string.punctuation).lower().split())


def test_inferred_types(spark):
    for value, kind in (("a.b@c.org", "EMAIL_ADDRESS"), ("IT60X0542811101000000123456", "IBAN_CODE"), ("Iban IT60X0542811101000000123456", "PHONE_NUMBER"), ("+39 02 1234567", "PHONE_NUMBER"), ("4111111111111111", "PHONE_NUMBER"), ("Rossi", "DATA"), ("", "DATA")):
        assert one(spark, text.infer_type, value) == kind
    assert one(spark, lambda c: text.infer_type(c, fixed=True), "4111111111111111") == "CREDIT_CARD"


def test_entity_names(spark):
    for value, name in (("person", "PERSON"), (None, "DATA"), ("__", "DATA"), ("credit card!", "CREDIT_CARD"), ("é", "DATA")):
        assert one(spark, text.entity_name, value) == name


def test_match_offsets_against_python(spark):
    rng = random.Random(2)
    for _ in range(20):
        s = "".join(rng.choices("ab1 é\n", k=60))
        got = spark.createDataFrame([(s,)], "x string").select(text.matches(F.col("x"), F.lit("[ab]+1?")).alias("m")).first().m
        assert [(m.text, m.start, m.end) for m in got] == [(m[0], m.start(), m.end()) for m in re.finditer("[ab]+1?", s)]


def test_registry_reuses_and_separates(spark):
    found = values(spark, [("d", 1, 0, "person", "Mario Rossi"), ("d", 2, 5, "PERSON", "mario  rossi"), ("d", 2, 9, "location", "Roma"), ("d", 3, 0, "person", "Roma"), ("e", 1, 0, "person", "Roma"), ("d", -4, 0, None, "Straße"), ("d", 9, 0, None, "STRASSE")])
    got = {(r.container, r.placeholder): (r.original, r.page_no) for r in registry.assign(found).collect()}
    assert got == {("d", "PERSON_001"): ("Mario Rossi", 1), ("d", "LOCATION_001"): ("Roma", 2), ("d", "PERSON_002"): ("Roma", 3), ("e", "PERSON_001"): ("Roma", 1), ("d", "DATA_001"): ("Straße", 0)}


def test_registry_beyond_999_and_over_ranges(spark):
    found = values(spark, [("d", i * 7, 0, "person", f"v{i}") for i in range(1500)])
    got = {r.original: r.placeholder for r in registry.assign(found).collect()}
    assert got == {f"v{i}": f"PERSON_{i + 1:03d}" for i in range(1500)}


def test_registry_avoids_names_in_the_text(spark):
    got = registry.assign(values(spark, [("d", 1, 0, "person", "x y")]), spark.createDataFrame([("d", "PERSON_001")], "container string, placeholder string"))
    assert got.first().placeholder == "PERSON_X_001"


def greedy(rows, disjoint):
    kept = []
    for x in sorted(set(rows), key=lambda r: (r[0], -len(r[1]), r[1], r[2], r[3])):
        centre = (x[2] + x[3]) / 2
        if not any((x[2] < k[3] and k[2] < x[3]) if disjoint else k[2] <= centre < k[3] for k in kept):
            kept.append(x)
    return sorted(kept)


@pytest.mark.parametrize("disjoint", [False, True])
def test_overlap_suppression_against_a_loop(spark, disjoint):
    rng = random.Random(3)
    cases = {}
    for p in range(30):
        rows = []
        for _ in range(rng.randrange(1, 9)):
            a, n = rng.randrange(30), rng.randrange(1, 9)
            rows.append((rng.randrange(4), "x" * n, a, a + n))
        cases[p] = rows
    df = spark.createDataFrame([("c", p, *r, "T") for p, rows in cases.items() for r in rows], "container string, page_no bigint, priority int, term string, start bigint, end bigint, entity_type string")
    got = {}
    for r in spans.resolve(df, disjoint).collect():
        got.setdefault(r.page_no, []).append((r.priority, r.term, r.start, r.end))
    assert {p: sorted(v) for p, v in got.items()} == {p: greedy(rows, disjoint) for p, rows in cases.items()}


def test_occurrences_in_blocks_of_terms(spark, monkeypatch):
    p = spark.createDataFrame([("c", 1, "Ab ab. xabx"), ("c", 2, "none"), ("c", 3, None)], pages.PAGES)
    terms = spark.createDataFrame([("ab",), ("x",), ("zz",)], "term string")
    whole = sorted(map(tuple, spans.occurrences(p, terms).collect()))
    assert whole == [("c", 1, "ab", 0, 2), ("c", 1, "ab", 3, 5), ("c", 1, "ab", 8, 10), ("c", 1, "x", 7, 8), ("c", 1, "x", 10, 11)]
    monkeypatch.setattr(spans, "TERMS", 1)
    assert sorted(map(tuple, spans.occurrences(p, terms).collect())) == whole
    assert len(spans.occurrences(p, terms, whole_word=True).collect()) == 2


def test_anonymize_leaves_nothing_under_a_span(spark):
    p = spark.createDataFrame([("c", 1, "0123456789")], pages.PAGES)
    s = spark.createDataFrame([("c", 1, 1, 4), ("c", 1, 3, 6), ("c", 1, 8, 9)], "container string, page_no bigint, start bigint, end bigint")
    assert export.anonymize(p, s).first().text == "0679"
    assert export.anonymize(p, s, "#").first().text == "0#67#9"
    with pytest.raises(ValueError, match="mode"):
        export.export("other", p, s)


def test_restore_takes_whole_tokens(spark):
    p = spark.createDataFrame([("c", 1, "PERSON_100 and PERSON_1000, X_001"), ("c", 2, "none")], pages.PAGES)
    r = spark.createDataFrame([("c", "PERSON_100", "a"), ("c", "PERSON_1000", "$1 \\b")], "container string, placeholder string, original string")
    assert {x.page_no: x.text for x in export.restore(p, r).collect()} == {1: "a and $1 \\b, X_001", 2: "none"}


def test_vault_round_trip(spark):
    payload = {"format": "x", "entries": [{"placeholder": "EMAIL_ADDRESS_001", "original": "a@b.org"}], "output_sha256": None}
    data = vault.encrypt(spark, payload, "a long password")
    assert b"a@b.org" not in data and vault.decrypt(spark, data, "a long password") == payload
    for change in (lambda d: d.replace(b'"iterations": 600000', b'"iterations": 600001'), lambda d: d.replace(b'"iterations": 600000', b'"iterations": 9'), lambda d: d.replace(b'"version": 1', b'"version": 2')):
        with pytest.raises(ValueError):
            vault.decrypt(spark, change(data), "a long password")
    with pytest.raises(ValueError):
        vault.decrypt(spark, data, "another password")
    with pytest.raises(ValueError):
        vault.encrypt(spark, payload, "short")


def test_payloads_keep_nulls(spark):
    found = values(spark, [("dir/a.pdf", 1, 0, "person", "x y")])
    sources = spark.createDataFrame([("dir/a.pdf", "00", None)], "container string, source_sha256 string, output_sha256 string")
    got = vault.payloads(registry.assign(found), sources).first().payload
    assert '"source_name":"a.pdf"' in got and '"output_sha256":null' in got and "PERSON_001" in got


def test_dictionaries_round_trip(spark, tmp_path):
    path = str(tmp_path / "d")
    assert dictionaries.load(spark, path).count() == 0
    dictionaries.save(spark.createDataFrame([("Password ",), ("ab",), ("abc",), ("abc",)], "term string"), path)
    assert sorted(r.term for r in dictionaries.load(spark, path).collect()) == ["abc", "password"]


def test_leak_check_is_not_secure_when_it_could_not_read(spark):
    p = spark.createDataFrame([("a", 1, "x SECRET"), ("a", 2, "secret"), ("b", 1, None), ("c", 1, "fine")], pages.PAGES)
    needles = spark.createDataFrame([(c, "Secret") for c in "abc"], "container string, needle string")
    meta = spark.createDataFrame([("a", "my secret"), ("c", None)], "container string, value string")
    got = {r.container: (r.n_metadata, r.n_pages, r.raw_hit, r.alerts, r.verdict) for r in verify.leak_check(p, meta, needles, p.select("container", F.encode("text", "UTF-8").alias("content"))).collect()}
    assert got == {"a": (1, 2, 1, 4, "VULNERABLE"), "b": (0, 0, 0, 0, "INCONCLUSIVE"), "c": (0, 0, 0, 0, "SECURE")}


def test_allow_terms_keep_others(spark):
    rows = values(spark, [("c", 1, 0, "PERSON", v) for v in ("Rossi.", "Mario Rossi", "Rossini", "!!", "anna")])
    allow = spark.createDataFrame([("rossi",), ("anna bianchi",), ("!!",)], "term string")
    exact = detect.allowed_exactly(rows, allow)
    assert sorted(r.value for r in exact.collect()) == ["Mario Rossi", "Rossini", "anna"]
    assert [r.value for r in detect.allowed_fuzzily(exact, allow).collect()] == ["Rossini"]


def test_page_value_keeps_first_place_and_last_type(spark):
    rows = spark.createDataFrame([("c", 1, "x", "A", 3), ("c", 1, "x", "B", 9), ("c", 1, "X", "C", 5)], "container string, page_no bigint, value string, entity_type string, seq int")
    assert sorted((r.value, r.seq, r.entity_type) for r in detect.per_value(rows).collect()) == [("X", 5, "C"), ("x", 3, "B")]


def test_languages_and_entities_are_checked(spark):
    p = spark.createDataFrame([("c", 1, "x")], pages.PAGES)
    with pytest.raises(ValueError):
        pages.passes(p, "DE")
    with pytest.raises(ValueError):
        pages.ocr_codes("DE", None)
    with pytest.raises(ValueError):
        detect.detect(p, ("NOBODY",))


def test_recognition_reaches_only_pages_that_need_it(spark):
    p = spark.createDataFrame([("c", 1, "long enough to need nothing", 1), ("c", 2, "", 1)], "container string, page_no bigint, text string, images int")
    got = {r.page_no: (r.text, r.source) for r in pages.recognise(p, lambda texts, images: ["read" for _ in texts]).collect()}
    assert got == {1: ("long enough to need nothing", "text"), 2: ("read", "ocr")}


def test_payload_of_others_is_not_read(spark):
    rows = [('{"mark":1,"original":"x","entity_type":"T"}',), ('{"mark":2,"original":"x"}',), ("no",), (None,)]
    got = [r.p and r.p.original for r in spark.createDataFrame(rows, "c string").select(review.read_payload(F.col("c")).alias("p")).collect()]
    assert got == ["x", None, None, None]


def test_markup_is_scrubbed(spark):
    html = "<title>a</title><meta x><input name=a><select><option>x</select>b"
    assert one(spark, export.without_metadata, html) == "<input name=a><select><option>x</select>b"
    assert one(spark, export.without_widgets, html) == "<title>a</title><meta x>b"


def test_exports_hold_every_page(spark, tmp_path):
    rows = [(0, "mail a@b.org now", "s"), (1, "nothing to find", "s"), (2, "", "t")]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    texts = lambda df: sorted((r.container, r.page_no, r.text) for r in df.collect())
    assert texts(queries.export_pseudonymize(spark, str(tmp_path))) == [("s", 0, "mail EMAIL_ADDRESS_001 now"), ("s", 1, "nothing to find"), ("t", 2, "")]
    assert texts(queries.export_anonymize(spark, str(tmp_path))) == [("s", 0, "mail  now"), ("s", 1, "nothing to find"), ("t", 2, "")]
    assert [r.same for r in queries.restore_roundtrip(spark, str(tmp_path)).collect()] == [True] * 3


def test_queries_cover_every_class(spark, tmp_path):
    parts = ["a@b.org", "4111111111111111", "DE89370400440532013000", "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", "+44 20 7946 0958", "Onthan", "Heitü", "License"]
    spark.createDataFrame([(0, "; ".join(parts), "s")], "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    d = str(tmp_path)
    types = {"EMAIL_ADDRESS", "CREDIT_CARD", "IBAN_CODE", "CRYPTO", "PHONE_NUMBER", "PERSON", "LOCATION"}
    assert {r.entity_type for r in queries.detect_all(spark, d).collect()} == types
    assert {r.entity_type for r in queries.detect_occurrences(spark, d).collect()} >= types
    for query in (queries.export_pseudonymize, queries.export_anonymize):
        out = query(spark, d).first().text
        assert not [x for x in parts if x in out]
    planned = {r.term.lower() for r in queries.redact_plan(spark, d).collect()}
    assert planned == {x.lower() for x in parts}
    assert {r.original.lower() for r in queries.placeholder_assign(spark, d).collect()} == planned
    assert queries.restore_roundtrip(spark, d).first().same


def test_hits_lie_anywhere_on_a_page(spark, tmp_path):
    rows = [(0, " " * 9001 + "a@b.org", "s"), (1, " a@b.org", "s"), (2, "none", "s")]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((r.page_no, r.start) for r in queries.hit_test(spark, str(tmp_path)).collect()) == [(0, 9001), (1, 1)]


def test_printed_forms_and_names_of_two_words(spark):
    text = "card 4111 1111 1111 1111 or 4111-1111-1111-1111, iban DE89 3704 0044 0532 0130 00 by Mario Rossi, not Mario Rossini; 3782 822463 10005 and 4111 1111 1111 1112"
    p = spark.createDataFrame([("a", 1, text), ("a", 2, None), ("a", 3, "")], pages.PAGES)
    names = spark.createDataFrame([("Mario Rossi", "PERSON"), ("L'Aquila", "LOCATION"), ("--- ", "PERSON")], "term string, entity_type string")
    got = sorted((r.start, r.entity_type, r.value, r.end) for r in detect.detect(p, names=names).collect() if r.entity_type != "PHONE_NUMBER")
    assert [(t, v) for _, t, v, _ in got] == [("CREDIT_CARD", "4111 1111 1111 1111"), ("CREDIT_CARD", "4111-1111-1111-1111"), ("IBAN_CODE", "DE89 3704 0044 0532 0130 00"), ("PERSON", "Mario Rossi"), ("CREDIT_CARD", "3782 822463 10005")]
    assert all(text[a:b] == v for a, _, v, b in got)
    hidden = export.anonymize(p, detect.detect(p, names=names)).where("page_no = 1").first().text
    assert not any(v in hidden for _, t, v, _ in got if t != "PERSON") and "by , not Mario Rossini" in hidden


def test_restoring_beside_letters_digits_and_other_values(spark):
    texts = ["TEL5551234567", "a@b.com123", "x a@b.com5551234567 y", "a@b.com", "", "no value"]
    p = spark.createDataFrame([("c", i, t) for i, t in enumerate(texts)], pages.PAGES)
    rows = [(0, "PHONE_NUMBER", "5551234567", 3, 13), (1, "EMAIL_ADDRESS", "a@b.com", 0, 7), (2, "EMAIL_ADDRESS", "a@b.com", 2, 9), (2, "PHONE_NUMBER", "5551234567", 9, 19), (3, "EMAIL_ADDRESS", "a@b.com", 0, 7)]
    found = spark.createDataFrame([("c", *r) for r in rows], "container string, page_no bigint, entity_type string, value string, start bigint, end bigint")
    names = registry.assign(found)
    hidden = export.pseudonymize(p, registry.lookup(found, names))
    assert [r.text for r in hidden.orderBy("page_no").collect()][3:] == ["EMAIL_ADDRESS_001", "", "no value"]
    assert [r.text for r in export.restore(hidden, names).orderBy("page_no").collect()] == texts


def test_blank_needles_are_none(spark):
    p = spark.createDataFrame([("a", 1, "x")], pages.PAGES)
    meta = spark.createDataFrame([("a", "y")], "container string, value string")
    needles = spark.createDataFrame([("a", ""), ("a", " "), ("a", None), ("a", "z")], "container string, needle string")
    files = spark.createDataFrame([("a", bytearray(b"\x00Zz"))], "container string, content binary")
    assert [tuple(r) for r in verify.leak_check(p, meta, needles, files).collect()] == [("a", "z", 0, 0, 1, 1, "VULNERABLE")]


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 20000])
def test_match_offsets_of_many_matches(spark, n):
    rows = spark.createDataFrame([("é ab1 " * n,)], "x string").select(F.explode(text.matches(F.col("x"), F.lit("ab1"))).alias("m")).select("m.*").collect()
    assert [(r.text, r.start, r.end) for r in rows] == [("ab1", 6 * i + 2, 6 * i + 5) for i in range(n)]


def test_detectors_share_one_scan(spark):
    p = spark.createDataFrame([("d", 1, "a@b.org, 4111 1111 1111 1111, 1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa, 1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNb"), ("d", 2, None), ("d", 3, "")], pages.PAGES)
    found = detect.detect(p)
    assert sorted((r.entity_type, r.value) for r in found.collect()) == [("CREDIT_CARD", "4111 1111 1111 1111"), ("CRYPTO", "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa"), ("EMAIL_ADDRESS", "a@b.org")]
    assert found._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 1
    assert detect.detect(p, ("PERSON",)).count() == 0


def test_allowed_exactly_broadcast_or_not(spark, monkeypatch):
    found = spark.createDataFrame([(i, v) for i, v in enumerate(("The", "the,", "cat", "--", None, "Cat!", "dog"))], "id int, value string")
    allow = spark.createDataFrame([("the",), ("cat",), ("cat",), (None,)], "term string")
    few = sorted(map(tuple, detect.allowed_exactly(found, allow).select("id", "value", "clean").collect()))
    monkeypatch.setattr(detect, "TERMS", 1)
    assert sorted(map(tuple, detect.allowed_exactly(found, allow).select("id", "value", "clean").collect())) == few == [(6, "dog", "dog")]


def test_merged_spans_against_points(spark):
    rng = random.Random(5)
    rows = [(c, 1, a, a + rng.randrange(1, 9)) for c in "de" for a in (rng.randrange(200) for _ in range(40))]
    got = export.merged(spark.createDataFrame(rows, "container string, page_no bigint, start bigint, end bigint")).collect()
    for c in "de":
        own = sorted((r.start, r.end) for r in got if r.container == c)
        assert all(x[1] < y[0] for x, y in zip(own, own[1:]))
        assert {i for a, b in own for i in range(a, b)} == {i for k, _, a, b in rows if k == c for i in range(a, b)}


def test_plan_puts_images_first_and_leaves_marks(spark):
    at = lambda *rows: spark.createDataFrame([("d", 1, a, b) for a, b in rows], "container string, page_no bigint, start bigint, end bigint")
    named = lambda df, term, kind: df.withColumns({"term": F.lit(term), "entity_type": F.lit(kind)})
    blocked, found = named(at((0, 4), (20, 24)), "term", "DATA"), named(at((20, 26), (40, 46), (60, 66), (80, 86)), "found!", "PERSON")
    got = spans.plan(blocked, found, protected=at((62, 63)), images=at((0, 9)), existing=at((41, 45)), disjoint=True).collect()
    assert sorted((r.start, r.end, r.entity_type) for r in got) == [(0, 9, "IMAGE"), (20, 24, "DATA"), (80, 86, "PERSON")]


def test_marks_name_their_payload_first(spark):
    p = spark.createDataFrame([("d", 1, "by Mario Rossi, a@b.org  ")], pages.PAGES)
    said = '{"mark":1,"original":"Mario Rossi","entity_type":"PERSON"}'
    marks = spark.createDataFrame([("d", 1, 3, 8, said), ("d", 1, 16, 23, "no json"), ("d", 1, 23, 25, None)], "container string, page_no bigint, start bigint, end bigint, content string")
    got = {r.start: (r.entity_type, r.value) for r in export.named_marks(p, marks).collect()}
    assert got[3] == ("PERSON", "Mario Rossi") and got[16] == ("EMAIL_ADDRESS", "a@b.org") and got[23][0] == "IMAGE"


def test_map_is_written_before_and_apart_from_texts(spark, tmp_path):
    texts = spark.createDataFrame([("d", 1, "x")], pages.PAGES)
    maps = spark.createDataFrame([("d", bytearray(b"sealed"))], "container string, content binary")
    with pytest.raises(ValueError):
        export.save(texts, str(tmp_path / "out"), maps, str(tmp_path / "out/map"))
    with pytest.raises(ValueError):
        export.save(texts, str(tmp_path / "out"), maps)
    (tmp_path / "there").mkdir()
    with pytest.raises(Exception):
        export.save(texts, str(tmp_path / "out"), maps, str(tmp_path / "there"))
    assert not (tmp_path / "out").exists()
    export.save(texts, str(tmp_path / "out"), maps, str(tmp_path / "map"))
    assert spark.read.parquet(str(tmp_path / "out")).columns == ["container", "page_no", "text"]
    assert bytes(spark.read.parquet(str(tmp_path / "map")).first().content) == b"sealed"


def test_open_files_and_refusals(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 plain")
    (tmp_path / "b.PDF").write_bytes(b"%PDF-1.4 trailer << /Encrypt 5 0 R >>")
    (tmp_path / "c.txt").write_bytes(b"x")
    got = {r.path.rsplit("/", 1)[1]: r.refused for r in pages.open_files(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": None, "b.PDF": "password-protected", "c.txt": "not a pdf"}
    for path in ("", None):
        with pytest.raises(ValueError):
            pages.open_files(spark, path)
    with pytest.raises(Exception):
        pages.open_files(spark, str(tmp_path / "missing.pdf")).collect()


def test_first_folder_with_data(spark, tmp_path):
    for name in ("none", "first", "second"):
        (tmp_path / name).mkdir()
    (tmp_path / "none" / "readme").touch()
    for name in ("first", "second"):
        (tmp_path / name / "eng.traineddata").touch()
    assert pages.find_data(spark, ["", *(str(tmp_path / n) for n in ("missing", "none", "second", "first"))]) == str(tmp_path / "second")
    assert pages.find_data(spark, [str(tmp_path / "none")]) is None


def test_page_numbers(spark):
    rows = spark.createDataFrame([(x,) for x in (" 1 ", "5", "6", "0", "-1", "x", "", None)], "x string").select(pages.page_number(F.col("x"), F.lit(5)).alias("y")).collect()
    assert [r.y for r in rows] == [0, 4, None, None, None, None, None, None]


def brute_leaks(needles, pages, metadata, files):
    """Alerts by layer of each needle, every text met by every needle of its container."""
    low = lambda raw: raw.decode("latin-1").lower()
    of = lambda rows, c: [x for own, x in rows if own == c and x is not None]
    return sorted((c, n, sum(n.lower() in x.lower() for x in of(metadata, c)), sum(n.lower() in x.lower() for x in of(pages, c)), int(any(low(n.encode()) in low(x) for x in of(files, c)))) for c, n in set(needles) if n and n.strip())


@pytest.mark.parametrize("block", [1, 200_000])
def test_leak_check_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(verify, "NEEDLES", block)
    monkeypatch.setattr(verify, "TOGETHER", 5)
    needles = [("a", x) for x in ("x", "Éa", "ab", "aba", "12345678", "123456789", "Anna.Rossi@mail.example.com", "rossi@mail.example.com", "mail.example.com", "İx", "ends here")] + [("b", "Anna.Rossi@mail.example.com"), ("b", "ab"), ("d", "no pages"), ("a", "ab"), ("a", None)]
    texts = ["", None, "ababab éA", "0123456789", "by ANNA.ROSSI@MAIL.EXAMPLE.COM, anna.rossi@mail.example.com", "12345678", "1234567", "i̇X", "it ends here", "ends her", "e and more", "mail.example.co"]
    pages_rows, metadata = [(c, t) for c in "ab" for t in texts] + [(None, "ab")], [("a", "mail.example.com"), ("a", "AB"), ("a", None), ("b", "ends here")]
    files = [(c, t.encode()) for c, t in pages_rows if t is not None]
    frames = [spark.createDataFrame(rows, schema) for rows, schema in ((pages_rows, "container string, text string"), (metadata, "container string, value string"), (needles, "container string, needle string"), (files, "container string, content binary"))]
    got = verify.leak_check(*frames).collect()
    assert sorted((r.container, r.needle, r.n_metadata, r.n_pages, r.raw_hit) for r in got) == brute_leaks(needles, pages_rows, metadata, files)
    assert {r.container: r.verdict for r in got if r.needle in ("x", "no pages")} == {"a": "INCONCLUSIVE", "d": "SECURE"}


def test_leak_check_does_not_join_pages_with_needles(spark):
    p = spark.createDataFrame([("a", 1, "x")], pages.PAGES)
    none = p.select("container", F.col("text").alias("needle"))
    plan = verify.leak_check(p, p.select("container", F.col("text").alias("value")), none, p.select("container", F.encode("text", "UTF-8").alias("content")))
    assert plan._jdf.queryExecution().optimizedPlan().toString().lower().count("contains(") == 0
    assert verify.leak_check(p, p.select("container", F.col("text").alias("value")), none.where("false")).collect() == []
