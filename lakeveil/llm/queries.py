"""The queries of this package: thin applications of the operators to whole tables, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gam, hosts, lattice, line_dedup, maxscore, packing, parity_join, secrets, token_counts, winnowing

Query = Callable[[SparkSession, str], DataFrame]

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary file lies; the operators take paths or contents as parameters."""
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(key: Column) -> Column:
    return F.crc32(key.cast("string")) % 5


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(table(spark, sf_dir, "embeddings"), F.col("key") % 50 == 0, 5, scale=256.0)


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = token_counts.unigram_vocabulary(tokenizer_file("piece_bpe_32k.model"))
    docs = table(spark, sf_dir, "documents")
    return lattice.score_texts(docs, vocabulary, fold(docs["doc_id"]) == 1)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gam.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(F.col("key")) == 0)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return hosts.judge_urls(pages, hosts.outcomes_by_number(pages, table(spark, sf_dir, "labels")), RULES).drop("share", "bound")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(tokenizer_file("word_bpe_49k.json"), encoding="utf-8") as f:
        return packing.pack(table(spark, sf_dir, "documents"), f.read())


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.join_similar(table(spark, sf_dir, "documents"), width=3, num=90, den=100)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), token_counts.unigram_vocabulary(tokenizer_file("piece_bpe_32k.model")))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnowing.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda n, x: n + x["end"] - x["start"])
    items = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), items.alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents")).drop("found")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_top_k, op2_lm_score, op3_quality, op4_url_filter, op5_packing, op6_ngram_join, op7_line_dedup, op8_token_counts, op9_decontaminate, op10_secrets, pipeline)}

TOP_K_SQL = """
WITH valid AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM valid q JOIN valid c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""

TWO_LABELS = ", ".join(f"'{s}'" for s in hosts.SUFFIXES)
URL_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parsed AS (
  SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS bare FROM (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut)
), known AS (
  SELECT doc_id, max(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id
), outcomes AS (
  SELECT p.bare AS host, k.bad FROM parsed p JOIN known k ON k.doc_id = TRY_CAST(regexp_extract(p.path, '^/[^/]*/([0-9]{1,18})', 1) AS BIGINT)
), by_host AS (
  SELECT h.host, CASE WHEN two IN (""" + TWO_LABELS + """) THEN array_to_string(string_split(h.host, '.')[-3:], '.') ELSE two END AS domain,
    CASE WHEN two IN (""" + TWO_LABELS + """) THEN two ELSE string_split(h.host, '.')[-1] END AS suffix,
    count(o.bad) AS n, CAST(coalesce(sum(o.bad), 0) AS BIGINT) AS bad
  FROM (SELECT DISTINCT bare AS host, array_to_string(string_split(bare, '.')[-2:], '.') AS two FROM parsed) h LEFT JOIN outcomes o ON o.host = h.host GROUP BY h.host, two
), by_domain AS (
  SELECT domain, suffix, CAST(sum(n) AS BIGINT) AS n, CAST(sum(bad) AS BIGINT) AS bad FROM by_host GROUP BY domain, suffix
), by_suffix AS (
  SELECT suffix, CAST(sum(n) AS BIGINT) AS n, CAST(sum(bad) AS BIGINT) AS bad FROM by_domain GROUP BY suffix
), sums AS (
  SELECT level, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) AS bad, CAST(sum(n * n) AS DOUBLE) AS n2, sum(bad * bad / n) AS s, count(*) AS m
  FROM (SELECT 'host' AS level, n, bad FROM by_host UNION ALL SELECT 'domain', n, bad FROM by_domain UNION ALL SELECT 'suffix', n, bad FROM by_suffix)
  WHERE n > 0 GROUP BY level
), strengths AS (
  SELECT l.level, CASE WHEN s.level IS NULL OR s.bad <= 0 OR s.bad >= s.n THEN 2.0 ELSE 1 / least(0.5, greatest(0.001,
    CASE WHEN s.n - s.n2 / s.n - (s.m - 1) > 0
      THEN ((s.s - s.bad * (s.bad / s.n)) / ((s.bad / s.n) * (1 - s.bad / s.n)) - (s.m - 1)) / (s.n - s.n2 / s.n - (s.m - 1)) ELSE 0 END)) - 1 END AS strength
  FROM (VALUES ('host'), ('domain'), ('suffix')) l(level) LEFT JOIN sums s ON s.level = l.level
), m AS (
  SELECT max(strength) FILTER (WHERE level = 'host') AS host, max(strength) FILTER (WHERE level = 'domain') AS domain, max(strength) FILTER (WHERE level = 'suffix') AS suffix FROM strengths
), whole AS (SELECT (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 1) AS p FROM by_suffix),
of_suffix AS (SELECT s.suffix, (s.bad + m.suffix * p) / (s.n + m.suffix) AS share FROM by_suffix s, m, whole),
of_domain AS (SELECT d.domain, (d.bad + m.domain * s.share) / (d.n + m.domain) AS share FROM by_domain d JOIN of_suffix s USING (suffix), m),
of_host AS (SELECT h.host, h.n, m.host AS strength, (h.bad + m.host * d.share) / (h.n + m.host) AS share FROM by_host h JOIN of_domain d USING (domain), m),
judged AS (SELECT host, share - 1.645 * sqrt(share * (1 - share) / (n + strength + 1)) > 0.25 AS bad FROM of_host),
rules(verdict, rule_host, rule_path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fitting AS (
  SELECT p.page_id, p.host, p.bare, p.path, r.rule_host || r.rule_path AS rule, r.verdict,
    row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule_host || r.rule_path) DESC NULLS LAST, r.rule_host || r.rule_path) AS k
  FROM parsed p LEFT JOIN rules r ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
)
SELECT page_id, f.host, path, rule, coalesce(verdict, CASE WHEN j.bad THEN 'block' ELSE 'allow' END) AS verdict
FROM fitting f JOIN judged j ON j.host = f.bare WHERE k = 1
"""

NGRAM_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS s FROM words
), classes AS (SELECT min(doc_id) AS class, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
one AS (SELECT class, n, unnest(s) AS x FROM classes),
common AS (SELECT a.class AS u, b.class AS v, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS shared FROM one a JOIN one b ON a.x = b.x AND a.class < b.class AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 90 GROUP BY ALL),
links AS (SELECT u, v FROM common WHERE 100 * shared >= 90 * (n + m - shared)),
edges AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reached AS (SELECT class, class AS root FROM classes UNION SELECT e.v, r.root FROM reached r JOIN edges e ON e.u = r.class WHERE r.root < e.v),
roots AS (SELECT class, min(root) AS root FROM reached GROUP BY class)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(r.root, s.doc_id) AS component_id
FROM sets s LEFT JOIN classes c ON c.s = s.s LEFT JOIN roots r ON r.class = c.class
"""

LINES_SQL = """
WITH lines AS (
  SELECT doc_id, no, l[no] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS no FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL))
), words AS (
  SELECT line, min((doc_id, no)) AS place, list_filter(regexp_split_to_array(line, '[\\x09-\\x0D\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+'), lambda w: w <> '') AS w FROM lines GROUP BY line
), sets AS (
  SELECT row_number() OVER (ORDER BY place) AS id, line, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words WHERE len(w) > 0
), one AS (SELECT id, len(s) AS n, unnest(s) AS x FROM sets),
common AS (SELECT b.id, b.n + a.n AS total, count(*) AS c FROM one a JOIN one b ON a.x = b.x AND a.id < b.id AND least(a.n, b.n) * 5 >= greatest(a.n, b.n) * 4 GROUP BY a.id, b.id, a.n, b.n),
gone AS (SELECT DISTINCT id FROM common WHERE c * 5 >= (total - c) * 4),
kept AS (
  SELECT l.doc_id, l.no, l.line, s.id IS NOT NULL AND (g.id IS NOT NULL OR row_number() OVER (PARTITION BY l.line ORDER BY l.doc_id, l.no) > 1) AS removed
  FROM lines l LEFT JOIN sets s ON s.line = l.line LEFT JOIN gone g ON g.id = s.id
), texts AS (
  SELECT doc_id, CAST(count(*) AS BIGINT) AS n, CAST(count_if(removed) AS BIGINT) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE NOT removed), '') AS kept FROM kept GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL OR d.text = '' THEN 0 ELSE t.n END AS n_lines, coalesce(t.n_removed, 0) AS n_removed, CASE WHEN d.text IS NOT NULL THEN sha256(t.kept) END AS kept_sha256
FROM documents d LEFT JOIN texts t USING (doc_id)
"""

WINNOWING_SQL = """
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM benchmark WHERE item_id IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM windows),
grams AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT x.doc_id, x.n, x.i, y.item_id FROM grams x JOIN windows y ON y.n = x.n AND y.g = x.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLES: dict[str, str] = {"op1_top_k": TOP_K_SQL, "op4_url_filter": URL_SQL, "op6_ngram_join": NGRAM_SQL, "op7_line_dedup": LINES_SQL, "op9_decontaminate": WINNOWING_SQL}
