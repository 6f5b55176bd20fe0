import base64
import json
import math

import numpy as np
from pyspark.sql import functions as F

from lakeveil.llm import gam, hosts, queries, secrets

from . import cases


def test_classifier_on_held_out_labels(spark, small_dir):
    d = small_dir.replace("sf0.001", "sf0.1")
    got = {r.doc_id: r for r in queries.op3_quality(spark, d).collect()}
    labels = [r for r in spark.read.parquet(f"{d}/labels.parquet").collect() if got[r.doc_id].held_out]
    scores = np.array([got[r.doc_id].score for r in labels])
    y = np.array([r.quality for r in labels])
    good, bad = scores[y == 1], scores[y == 0]
    assert (good[:, None] > bad[None, :]).mean() > 0.9
    assert np.mean([got[r.doc_id].predicted == 1 for r in labels if r.quality == 1]) > 0.97
    assert all(r.held_out == cases.held(k, 0) for k, r in got.items())


def test_classifier_ignores_all_but_the_text(spark):
    rows = [(i, ("word " * (i % 7 + 3)) + ("!! $$ " * 9 if i % 3 == 0 else "fine")) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0, "x", 1) for i in range(0, 200)] + [(None, 1, 0, "x", 1), (3, None, 0, "x", 1), (999, 1, 0, "x", 1)], "doc_id bigint, quality int, toxic int, key string, x int")
    extra = [(1000, None), (1001, ""), (1002, rows[3][1]), (1003, rows[4][1]), (None, rows[4][1]), (1004, "x" * 50_000), rows[4]]
    docs = cases.documents(spark, rows + extra)
    got = gam.score_quality(docs, labels, queries.fold(F.col("key")) == 0).collect()
    assert len(got) == len(rows) + len(extra)
    by = {r.doc_id: r for r in got}
    assert by[1002].score == by[3].score and by[1003].score == by[4].score == by[None].score and by[1000].score == by[1001].score
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert by[3].predicted == 0 and by[4].predicted == 1
    kept = gam.keep_good(docs, labels, queries.fold(F.col("key")) == 0, tuple(docs.columns))
    assert kept.columns == docs.columns
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(repr(r.doc_id) for r in got if r.predicted)


def test_classifier_without_labels_or_documents(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    held = queries.fold(F.col("key")) == 0
    assert gam.score_quality(cases.documents(spark, []), none, held).collect() == []
    assert {r.score for r in gam.score_quality(cases.documents(spark, cases.awkward(n=3)), none, held).collect()} == {0.5}


def test_pairs_see_what_features_alone_cannot():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) == (x[:, 1] > 0.4)).astype(float)
    y[x[:, 2] < 0.05] = 1
    share = lambda pairs: ((gam.fit(x, y, 60, pairs).score(x) > 0.5) == y).mean()
    assert share(4) > 0.9 > share(0)


def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    model = gam.fit(x, (x[:, 0] > 0).astype(float), 20, 2)
    bins = gam.binned(x, model.cuts)
    for i in range(20):
        total = model.intercept + sum(model.tables[j, bins[i, j]] for j in range(3))
        total += sum(t[bins[i, a] * 8 // 32, bins[i, b] * 8 // 32] for (a, b), t in zip(model.pairs, model.pair_tables))
        assert math.isclose(model.score(x[i : i + 1])[0], 1 / (1 + math.exp(-total)))


def cut(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min([i for i, c in enumerate(rest) if c in "/?#"], default=len(rest))
    path = rest[at:]
    end = min([i for i, c in enumerate(path) if c in "?#"], default=len(path))
    return rest[:at].translate(cases.LOWER), path[:end]


def test_urls_rules_and_reputation(spark):
    urls = [None, "", "no scheme/en", "http://", "HTTP://A.Example.ORG/es/1?x", "http://example.org/en/12", "http://notexample.org/es/", "http://x.org", "http://x.org?/es/", "http://b.com/de/5#f", "http://b.com/fr/", "http://com/de/", "ftp://u@h.net:80/a://b/?c", "http://É.net/ß", "http://bad.net/en/1", "http://good.net/en/1"]
    pages = spark.createDataFrame([(i, u, "h", "v", 1) for i, u in enumerate(urls)] + [(0, None, "h", "v", 1), (None, urls[4], "h", "v", 1)], "page_id bigint, url string, host string, verdict string, n int")
    outcomes = spark.createDataFrame([("bad.net", 1)] * 40 + [("good.net", 0)] * 40 + [("other.net", 0)] * 40 + [("gone.net", 1), ("good.net", None)], "host string, bad int")
    got = hosts.judge_urls(pages, outcomes, queries.RULES).collect()
    assert len(got) == len(urls) + 2
    by = {r.page_id: r for r in got}
    for i, u in enumerate(urls):
        assert (by[i].host, by[i].path) == cut(u)
    rules = {i: (r.rule, r.verdict) for i, r in by.items() if r.rule}
    assert rules == {None: ("example.org/es/", "block"), 4: ("example.org/es/", "block"), 5: ("example.org/en/1", "block"), 6: ("org/", "allow"), 9: ("com/de/", "block"), 10: ("com/fr/", "allow"), 11: ("com/de/", "block")}
    assert by[14].verdict == "block" and by[15].verdict == "allow" and by[7].rule is None
    assert by[15].share < by[12].share < by[14].share


def test_urls_without_outcomes_or_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id bigint, url string")
    none = spark.createDataFrame([], "host string, bad int")
    assert hosts.judge_urls(pages, none, queries.RULES).first().verdict == "allow"
    assert hosts.judge_urls(pages.limit(0), none, queries.RULES).collect() == []


def der(tag, content):
    n = len(content)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x80 + (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")) + content


def rsa_key():
    whole = [b"\0", b"\0" + b"\xaa" * 128, b"\1\0\1", b"\xbb" * 128, *[b"\xcc" * 64] * 5]
    return der(0x30, b"".join(der(2, x) for x in whole))


def token(head):
    return ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (json.dumps(head).encode(), b'{"sub":1}', b"\1\2\3"))


def test_structures_are_confirmed():
    key = rsa_key()
    text = f"é {base64.b64encode(key).decode()} then {key.hex()} {token({'alg': 'HS256'})}"
    kinds = [k for _, k, _ in secrets.in_order(secrets.confirmed_spans(text))]
    assert kinds == ["der", "der", "jwt"]
    a, _, b = secrets.in_order(secrets.confirmed_spans(text))[0]
    assert base64.b64decode(text[a:b]) == key
    assert secrets.confirmed_spans(base64.b64encode(key[:-1]).decode()) == []
    assert secrets.confirmed_spans(base64.b64encode(bytes(400)).decode()) == []
    assert secrets.confirmed_spans(token({"typ": "JWT"})) == []
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + base64.encodebytes(key).decode() + "-----END RSA PRIVATE KEY-----"
    assert ("pem", 0, len(pem)) in [(k, a, b) for a, k, b in secrets.confirmed_spans(pem)]
    ssh = b"openssh-key-v1\0" + strings(b"none", b"none", b"") + (1).to_bytes(4, "big") + strings(strings(b"ssh-ed25519", b"\7" * 32), b"\5" * 8 + b"\6" * 64)
    assert [k for _, k, _ in secrets.confirmed_spans(base64.b64encode(ssh).decode())] == ["openssh"]
    for bad in (ssh[:-9], ssh[: len(ssh) - 76 - 55] + bytes(131), b"openssh-key-v1\0" + bytes(60)):  # blobs cut, empty, or none
        assert secrets.confirmed_spans(base64.b64encode(bad).decode()) == []


def strings(*parts):
    return b"".join(len(x).to_bytes(4, "big") + x for x in parts)


def test_keys_as_they_are_written_elsewhere():
    key = rsa_key()
    plain = base64.b64encode(key).decode()
    wrapped = base64.encodebytes(key).decode()
    kinds = lambda t: sorted({k for _, k, _ in secrets.confirmed_spans(t)})
    assert kinds(wrapped) == ["der"] and kinds("\n".join("  " + x for x in wrapped.split("\n")) + "\nwords after it") == ["der"]
    a, _, b = secrets.confirmed_spans(f"é key:\r\n{wrapped.replace(chr(10), chr(13) + chr(10))}tail")[0]
    assert base64.b64decode(f"é key:\r\n{wrapped.replace(chr(10), chr(13) + chr(10))}tail"[a:b]) == key
    assert kinds(f"path/key/{plain}") == ["der"] and kinds(base64.urlsafe_b64encode(key).decode().rstrip("=")) == ["der"]
    assert kinds(":".join(f"{x:02x}" for x in key)) == ["der"]
    armour = "-----BEGIN PRIVATE KEY-----{0}" + "{0}".join(wrapped.split("\n")) + "-----END PRIVATE KEY-----"
    assert all("pem" in kinds('{"key": "' + armour.format(end) + '"}') for end in ("\n", "\\n", "\\r\\n", " "))
    wrapped_key = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2a\x86\x48") + der(5, b"")) + der(4, key))
    assert kinds(base64.b64encode(wrapped_key).decode()) == ["der"]
    empty = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2a\x86\x48") + der(5, b"")) + der(4, key[:-1]))
    assert kinds(base64.b64encode(empty).decode()) == []
    dsa = der(0x30, b"".join(der(2, x) for x in (b"\0", b"\x7a" * 128, b"\x7b" * 20, b"\x7c" * 128, b"\x7d" * 128, b"\x7e" * 20)))
    assert kinds(base64.b64encode(dsa).decode()) == ["der"]
    lopsided = der(0x30, b"".join(der(2, x) for x in (b"\0", b"\x7a" * 128, b"\1\0\1", *[b"\x7c" * 128] * 6)))
    assert kinds(base64.b64encode(lopsided).decode()) == []
    spaced = ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (b'{ "alg": "HS256" }', b'{\n"sub":1}', b"\1\2"))
    assert kinds(spaced) == ["jwt"]


def test_long_texts_take_time_in_proportion():
    import time

    key = "-----BEGIN RSA PRIVATE KEY-----\n" + base64.encodebytes(rsa_key()).decode() + "-----END RSA PRIVATE KEY-----"
    head = "-----BEGIN RSA PRIVATE KEY-----\n"
    for text in (head * 200_000 + key, "-----END RSA PRIVATE KEY-----" * 200_000 + key, "M" * 4_000_000 + "\n" + key, "MIIE/" * 800_000 + "\n\n" + key, "a1" * 2_000_000 + " " + key):
        began = time.process_time()
        assert "pem" in [k for _, k, _ in secrets.confirmed_spans(text)]
        assert time.process_time() - began < 20


def brute_secrets(text):
    """The patterns as they are stated, each on its own."""
    import regex

    text = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in regex.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, regex.ASCII) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in regex.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in regex.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out)), [sum(x[2] == k for x in out) for k in ("assign", "access", "hex")]


def test_secrets_against_the_patterns(spark, small_dir):
    import hashlib

    rows = [(r.doc_id, r.text) for d in ("sf0.001", "sf0.01") for r in spark.read.parquet(f"{small_dir.replace('sf0.001', d)}/documents.parquet").collect()]
    rows = [(i, t) for i, (_, t) in enumerate(rows)] + [(9000 + i, t) for i, t in enumerate((
        None, "", "é PassWord: 'abc-def' token=short", "api_key==abcdef", "toKen = x", "ſecret=abcdef", "AKIAAKIA" + "B" * 12, "AKIA" + "B" * 15, "a" * 24 + "g" + "0" * 23, "😀" * 3 + "secret=" + "f" * 30, "z" * 40_000 + " token:abcdefgh",
    ))]
    got = {r.doc_id: r for r in secrets.find_secrets(cases.documents(spark, rows + rows[:1] + [(None, "token=abcdef")])).collect()}
    assert len(got) == len(rows) + 1
    for key, t in rows:
        spans, counts = brute_secrets(t)
        r = got[key]
        assert [r.n_assign, r.n_access, r.n_hex] == counts and r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert set(spans.split(",")) <= set(r.spans.split(","))
        assert r.spans == ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.found)
    assert secrets.find_secrets(cases.documents(spark, [])).collect() == []
