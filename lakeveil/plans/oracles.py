"""DuckDB SQL that says the same as the queries, written on its own: joins and list functions, no shared code."""

from __future__ import annotations

S = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
P = r"[!-/:-@\[-\x60{-~]"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
PHONE = r"\+?[0-9][0-9 ().-]{6,}[0-9]"
CARD = r"[0-9]{13,}|[0-9]{4}(?: [0-9]{4}){2} [0-9]{1,7}|[0-9]{4}(?:-[0-9]{4}){2}-[0-9]{1,7}|[0-9]{4} [0-9]{6} [0-9]{5}|[0-9]{4}-[0-9]{6}-[0-9]{5}"
IBAN = r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}|[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?"


def strip(x: str, chars: str = S) -> str:
    return f"regexp_replace({x}, '^{chars}+|{chars}+\\z', '', 'g')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{S}+', ' ', 'g'))"


def clean(x: str) -> str:
    return collapse(f"lower({strip(x, P)})")


def typed(x: str) -> str:
    c = collapse(x)
    j = f"replace({c}, ' ', '')"
    return f"""CASE WHEN regexp_matches({c}, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{{2,}}(?:[^\\p{{L}}\\p{{N}}_]|\\z)') THEN 'EMAIL_ADDRESS'
      WHEN regexp_matches({j}, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}(?:[^\\p{{L}}\\p{{N}}_]|\\z)') THEN 'IBAN_CODE'
      WHEN regexp_matches({c}, '\\+?[0-9][0-9\\s()./-]{{6,}}[0-9]') THEN 'PHONE_NUMBER'
      WHEN regexp_matches({j}, '(?:^|[^\\p{{L}}\\p{{N}}_])[0-9]{{13,19}}(?:[^\\p{{L}}\\p{{N}}_]|\\z)') THEN 'CREDIT_CARD' ELSE 'DATA' END"""


PAGES = "p AS (SELECT source AS container, doc_id AS page_no, text FROM documents)"


def hits(name: str, pattern: str, source: str = "p", extra: str = "") -> str:
    """CTE of matches with places; pattern is SQL. extra: columns of the source that go along."""
    return f"""{name}_m AS (SELECT container, page_no{extra}, regexp_extract_all(text, {pattern}) AS ms, string_split_regex(text, {pattern}) AS gaps FROM {source} WHERE regexp_matches(text, {pattern})),
{name}_i AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM {name}_m),
{name} AS (SELECT container, page_no{extra}, ms[i] AS value, CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0) AS BIGINT) AS start,
  CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + list_sum(list_transform(ms[1:i], lambda g: length(g))) AS BIGINT) AS stop FROM {name}_i)"""


D = "regexp_replace(value, '[^0-9]', '', 'g')"
LUHN = f"""(list_sum(list_transform(range(1, length({D}) + 1), lambda i: CASE WHEN (length({D}) - i) % 2 = 0 THEN CAST({D}[i] AS INTEGER)
  WHEN CAST({D}[i] AS INTEGER) > 4 THEN 2 * CAST({D}[i] AS INTEGER) - 9 ELSE 2 * CAST({D}[i] AS INTEGER) END)) % 10 = 0)"""
DETECT = f"""{PAGES},
{hits("e", f"'{EMAIL}'")},
{hits("c", f"'{CARD}'")},
{hits("t", f"'{PHONE}'")},
found AS (
  SELECT container, page_no, 'EMAIL_ADDRESS' AS entity_type, value, start, stop FROM e
  UNION ALL SELECT container, page_no, 'CREDIT_CARD', value, start, stop FROM c WHERE length({D}) BETWEEN 13 AND 19 AND {LUHN}
  UNION ALL SELECT container, page_no, 'PHONE_NUMBER', value, start, stop FROM t WHERE length(regexp_replace(value, '[^0-9]', '', 'g')) BETWEEN 7 AND 15
)"""
#: Folds of a page's candidates in order: each list element is a list, so that the fold's state is one, too.
RANKED = """ranked AS (
  SELECT container, page_no, list_transform(list_distinct(list({'priority': priority, 'less': -length(term), 'term': term, 'start': start, 'stop': stop, 'entity_type': entity_type})), lambda x: x) AS every FROM cand GROUP BY container, page_no
), steps AS (SELECT container, page_no, list_transform(list_sort(every), lambda x: [x]) AS every FROM ranked)"""


def resolved(disjoint: bool) -> str:
    clash = "y.start < x[1].stop AND x[1].start < y.stop" if disjoint else "y.start <= (x[1].start + x[1].stop) / 2 AND (x[1].start + x[1].stop) / 2 < y.stop"
    return f"""{RANKED},
kept AS (SELECT container, page_no, unnest(list_reduce(every, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: {clash})) > 0 THEN acc ELSE list_concat(acc, x) END)) AS k FROM steps),
res AS (SELECT container, page_no, k.priority AS priority, k.term AS term, k.entity_type AS entity_type, k.start AS start, k.stop AS stop FROM kept)"""


def values(words) -> str:
    return ", ".join(f"('{w}')" for w in words)


BLOCK = values(("idiot", "pathetic", "worthless", "clown", "license"))


def occurs(name: str, words: str, source: str = "p") -> str:
    """CTE of the places of words in either case."""
    return f"""{name}_d(term) AS (VALUES {words}),
{name}_b AS (SELECT container, page_no, text, term FROM {source} JOIN {name}_d ON contains(lower(text), lower(term))),
{occurrences(name, f"{name}_b")}"""


def occurrences(name: str, source: str, extra: str = "") -> str:
    """CTE of places of each row's term: split at the lower-cased term, add up lengths."""
    return f"""{name}_s AS (SELECT container, page_no, term{extra}, string_split(lower(text), lower(term)) AS gaps FROM {source}),
{name}_n AS (SELECT *, unnest(range(1, len(gaps))) AS i FROM {name}_s),
{name} AS (SELECT container, page_no, term{extra}, CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + (i - 1) * length(term) AS BIGINT) AS start, CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + i * length(term) AS BIGINT) AS stop FROM {name}_n)"""


NAMES = "names(term, entity_type) AS (VALUES ('Theaea', 'PERSON'), ('Onthan', 'PERSON'), ('Zu', 'LOCATION'), ('Heitü', 'LOCATION'), ('Éréier', 'PERSON'))"
WORDS = hits("w", r"'[\p{L}\p{N}_]+'")
IBAN_VALID = """list_reduce(list_prepend(0, list_transform(string_split(array_to_string(list_transform(string_split(substr(replace(value, ' ', ''), 5) || substr(replace(value, ' ', ''), 1, 4), ''),
  lambda c: CASE WHEN ascii(c) >= 65 THEN CAST(ascii(c) - 55 AS VARCHAR) ELSE c END), ''), ''), lambda c: CAST(c AS INTEGER))), lambda a, c: (a * 10 + c) % 97) = 1 AND length(replace(value, ' ', '')) BETWEEN 15 AND 34"""
#: All classes but addresses with a checksum, which SQL can't decode: the driver's tables hold no valid one.
EVERY = f"""{DETECT},
{hits("ib", f"'{IBAN}'")},
{NAMES}, {WORDS},
every AS (SELECT * FROM found UNION ALL SELECT container, page_no, 'IBAN_CODE', value, start, stop FROM ib WHERE {IBAN_VALID}
  UNION ALL SELECT container, page_no, entity_type, value, start, stop FROM w JOIN names ON term = value WHERE length(value) > 2)"""
PRIORITY = "CASE entity_type WHEN 'EMAIL_ADDRESS' THEN 10 WHEN 'CREDIT_CARD' THEN 11 WHEN 'IBAN_CODE' THEN 12 WHEN 'PHONE_NUMBER' THEN 14 WHEN 'PERSON' THEN 15 ELSE 16 END"
CANDIDATES = f"""{EVERY},
{occurs("blk", BLOCK)},
cand AS (
  SELECT container, page_no, {PRIORITY} AS priority, value AS term, start, stop, entity_type FROM every
  UNION ALL SELECT blk.container, blk.page_no, 2, substr(p.text, start + 1, stop - start), start, stop, 'DATA' FROM blk JOIN p USING (container, page_no)
)"""
DISJOINT = f"{CANDIDATES},\n{resolved(True)}"
FOLD = f"lower(replace({collapse('term')}, 'ß', 'ss'))"
REGISTRY = f"""{DISJOINT},
firsts AS (
  SELECT container, entity_type, {FOLD} AS key, min((page_no, start)) AS place, arg_min(term, (page_no, start, term)) AS original FROM res GROUP BY container, entity_type, {FOLD}
), registry AS (
  SELECT container, entity_type, key, printf('%s_%03d', entity_type, row_number() OVER (PARTITION BY container, entity_type ORDER BY place, key)) AS placeholder, original, place[1] AS page_no FROM firsts
)"""


BOXES = """li AS (SELECT *, least(l_quantity, l_quantity + l_partkey % 17) AS x0, greatest(l_quantity, l_quantity + l_partkey % 17) AS x1, CAST(l_linenumber AS DOUBLE) AS y0, CAST(l_linenumber AS DOUBLE) * 3 AS y1 FROM lineitem)"""
LINES = "lines AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"
IBAN_ROWS = "SELECT * FROM p UNION ALL VALUES ('x', 1, 'pay DE89370400440532013000 now'), ('x', 2, 'bad DE89370400440532013001'), ('y', 3, 'GB82WEST12345698765432, FR1420041010050500013M02606.'), ('y', 4, 'in groups DE89 3704 0044 0532 0130 00 and GB82 WEST 1234 5698 7654 32')"
HTML = "h AS (SELECT CAST(page_id AS VARCHAR) AS container, CAST(0 AS BIGINT) AS page_no, html AS text FROM pages)"
MARKS = "m AS (SELECT p.*, a AS start, b AS stop FROM p, (VALUES (CAST(0 AS BIGINT), CAST(9 AS BIGINT)), (20, 44), (100000000, 100000009)) v(a, b))"
VALUES_OF = "vals AS (SELECT DISTINCT f.container, f.page_no, f.value AS term, f.entity_type, p.text FROM every f JOIN p USING (container, page_no))"
PLAN = f"""{EVERY},
{VALUES_OF},
{occurs("blk", BLOCK)},
{occurrences("det", "vals", ", entity_type")},
{occurs("safe", values(("mail5.example.com",)))},
cand AS (
  SELECT blk.container, blk.page_no, 2 AS priority, substr(p.text, start + 1, stop - start) AS term, start, stop, 'DATA' AS entity_type FROM blk JOIN p USING (container, page_no)
  UNION ALL SELECT container, page_no, 3, term, start, stop, entity_type FROM det WHERE NOT EXISTS (SELECT 1 FROM safe s WHERE s.container = det.container AND s.page_no = det.page_no AND s.start < det.stop AND det.start < s.stop)
),
{resolved(False)}"""
def rebuilt(apart: bool = False) -> str:
    """Pages with the spans of s replaced, and pages without any; apart: a separator beside letters, digits and other replacements."""
    word = "'[\\p{L}\\p{N}_]'"
    sides = (f"CASE WHEN (was = start AND k > 1) OR regexp_matches(substr(text, CAST(start AS BIGINT), 1), {word}) AND start > was THEN chr(8291) ELSE '' END", f"CASE WHEN regexp_matches(substr(text, stop + 1, 1), {word}) THEN chr(8291) ELSE '' END") if apart else ("''", "''")
    return f"""pieces AS (
  SELECT s.container, s.page_no, p.text, s.start, s.stop, s.replacement, lag(s.stop, 1, 0) OVER (PARTITION BY s.container, s.page_no ORDER BY s.start, s.stop) AS was, row_number() OVER (PARTITION BY s.container, s.page_no ORDER BY s.start, s.stop) AS k FROM s JOIN p USING (container, page_no)
), done AS (SELECT container, page_no, string_agg(substr(text, was + 1, greatest(start - was, 0)) || {sides[0]} || replacement || {sides[1]}, '' ORDER BY start, stop) || substr(any_value(text), max(stop) + 1) AS text FROM pieces GROUP BY container, page_no),
whole AS (SELECT p.container, p.page_no, coalesce(done.text, p.text) AS text, p.text AS was FROM p LEFT JOIN done USING (container, page_no))"""


ENTITY = "trim(regexp_replace(upper(coalesce(raw, '')), '[^A-Z0-9_]+', '_', 'g'), '_')"
CLEAN_FOUND = f"f AS (SELECT *, {clean('value')} AS clean FROM found)"

ORACLES: dict[str, str] = {
    "export_pseudonymize": f"WITH {REGISTRY}, s AS (SELECT r.container, r.page_no, r.start, r.stop, g.placeholder AS replacement FROM res r JOIN registry g ON g.container = r.container AND g.entity_type = r.entity_type AND g.key = {FOLD}),\n{rebuilt(True)} SELECT container, page_no, text FROM whole",
    "export_anonymize": f"""WITH {CANDIDATES},
      o AS (SELECT container, page_no, start, stop, max(stop) OVER (PARTITION BY container, page_no ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM cand),
      g AS (SELECT *, sum(CASE WHEN before IS NULL OR start > before THEN 1 ELSE 0 END) OVER (PARTITION BY container, page_no ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM o),
      s AS (SELECT container, page_no, min(start) AS start, max(stop) AS stop, '' AS replacement FROM g GROUP BY container, page_no, island),\n{rebuilt()} SELECT container, page_no, text FROM whole""",
    "restore_roundtrip": f"WITH {REGISTRY}, s AS (SELECT r.container, r.page_no, r.start, r.stop, g.original AS replacement FROM res r JOIN registry g ON g.container = r.container AND g.entity_type = r.entity_type AND g.key = {FOLD}),\n{rebuilt()} SELECT container, page_no, text = was AS same FROM whole",
    "src_accept": """SELECT page_id, path, CASE WHEN path = '' THEN 'empty' WHEN NOT ends_with(lower(path), '.pdf') THEN 'not a pdf' END AS refused
      FROM (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN '' WHEN page_id % 3 = 0 THEN split_part(split_part(url, '?', 1), '#', 1) || '.PDF' ELSE url END AS path FROM pages)""",
    "page_scan": "SELECT source AS container, count(*) AS n_pages, min(doc_id) AS first_page, max(doc_id) AS last_page, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents GROUP BY source",
    "page_text_html": f"""WITH a AS (SELECT page_id, regexp_replace(html, '(?s)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', ' ', 'g') AS x FROM pages),
      b AS (SELECT page_id, replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&') AS x FROM a)
      SELECT CAST(page_id AS VARCHAR) AS container, coalesce({collapse("x")}, '') AS text, CASE WHEN x IS NULL THEN 'no text' END AS extract_error FROM b""",
    "dialogue_scan": "SELECT CAST(conv_id AS VARCHAR) AS container, count(*) AS n_pages, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations GROUP BY conv_id",
    "span_text": f"SELECT doc_id, {strip('substr(text, 11, 30)')} AS span FROM documents",
    "ocr_need": f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN replace(text, 'e', chr(65533)) WHEN doc_id % 13 = 0 THEN substr(text, 1, 12) ELSE text END AS t, CASE WHEN doc_id % 5 > 0 THEN doc_id % 2 END AS images FROM documents)
      SELECT doc_id, CASE WHEN length({strip("t")}) >= 20 AND (length(t) - length(replace(t, chr(65533), ''))) / greatest(length(t), 1) < 0.05 THEN false WHEN images > 0 THEN true ELSE length({strip("t")}) < 20 END AS needed FROM d""",
    "scanned_preview": """WITH k AS (SELECT source, doc_id + 1 AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE doc_id % 6 = 3)
      SELECT source AS container, count(*) AS n_scanned, string_agg(CAST(n AS VARCHAR), ', ' ORDER BY n) FILTER (WHERE k <= 10) || CASE WHEN count(*) > 10 THEN '...' ELSE '' END AS preview FROM k GROUP BY source""",
    "first_match": "SELECT path FROM (VALUES (0, '/from/environment', false), (1, '/from/library', true), (2, '/from/bundle', true)) v(ord, path, found) WHERE found ORDER BY ord LIMIT 1",
    "ocr_lang": """SELECT id, 'eng' AS en, 'ita' AS it, coalesce(nullif(array_to_string(list_filter(['eng', 'ita'], lambda x: list_contains(installed, x)), '+'), ''), 'eng+ita') AS two FROM (VALUES (0, ['eng']), (1, ['eng', 'ita']), (2, ['deu'])) v(id, installed)""",
    "dict_load": f"SELECT DISTINCT term FROM (SELECT lower({strip('w')}) AS term FROM (SELECT unnest(regexp_split_to_array(text, '[ \\n]')) AS w FROM documents)) WHERE length(term) > 2",
    "dict_save": "SELECT string_agg(t, chr(10) ORDER BY t) AS content FROM (SELECT DISTINCT c_mktsegment AS t FROM customer)",
    "doc_digest": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "leak_raw": "SELECT CAST(doc_id AS VARCHAR) AS path FROM documents WHERE regexp_matches(text, '(?i)example\\.com')",
    "clean_form": f"WITH {LINES} SELECT doc_id, line_no, {clean('line')} AS clean FROM lines",
    "entity_filter": f"WITH {DETECT} SELECT entity_type, count(*) AS n FROM found WHERE entity_type <> 'PHONE_NUMBER' GROUP BY entity_type",
    "lang_expand": "SELECT language, pass, count(*) AS n_pages FROM documents, (VALUES ('en', 0), ('it', 1)) v(language, pass) GROUP BY language, pass",
    "min_box": f"WITH {BOXES} SELECT l_orderkey, l_linenumber, l_partkey FROM li WHERE x1 - x0 > 5 AND y1 - y0 > 5",
    "unscale": f"WITH {BOXES}, z AS (SELECT *, greatest(0.5, least(4.0, l_partkey / 64)) AS zoom FROM li) SELECT l_orderkey % 100 AS bucket, round(sum(x0 / zoom), 3) AS x0, round(sum(y1 / zoom), 3) AS y1, count(*) AS n FROM z GROUP BY l_orderkey % 100",
    "rect_ops": f"WITH {BOXES} SELECT l_orderkey, l_linenumber, l_partkey, x0 < 30 AND 20 < x1 AND y0 < 9 AND 4 < y1 AS meets, 20 <= (x0 + x1) / 2 AND (x0 + x1) / 2 < 30 AND 4 <= (y0 + y1) / 2 AND (y0 + y1) / 2 < 9 AS centred FROM li",
    "normalize_type": f"SELECT raw, CASE WHEN {ENTITY} = '' THEN 'DATA' ELSE {ENTITY} END AS name FROM (SELECT DISTINCT p_type AS raw FROM part)",
    "escape_html": "SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS escaped_sha256 FROM pages",
    "log_severity": "SELECT CASE event_id % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' WHEN 2 THEN 'success' ELSE 'info' END AS severity, count(*) AS n FROM events GROUP BY 1",
    "progress_pct": "SELECT done, total, count(*) AS n, CAST(CASE WHEN total <= 0 THEN 0 ELSE trunc(done * 100 / total) END AS INTEGER) AS percent FROM (SELECT l_linenumber AS done, l_orderkey % 8 AS total FROM lineitem) GROUP BY done, total",
    "detect_email": f"WITH {DETECT} SELECT * FROM found WHERE entity_type = 'EMAIL_ADDRESS'",
    "detect_phone": f"WITH {DETECT} SELECT * FROM found WHERE entity_type = 'PHONE_NUMBER'",
    "detect_card": f"WITH {DETECT} SELECT * FROM found WHERE entity_type = 'CREDIT_CARD'",
    "detect_iban": f"""WITH {PAGES}, q AS ({IBAN_ROWS}), r(container, page_no, text) AS (SELECT * FROM q), {hits("b", f"'{IBAN}'", "r")}
      SELECT container, page_no, 'IBAN_CODE' AS entity_type, value, start, stop FROM b WHERE {IBAN_VALID}""",
    "detect_lexicon": f"WITH {PAGES}, {NAMES}, {WORDS} SELECT container, page_no, entity_type, value, start, stop FROM w JOIN names ON term = value WHERE length(value) > 2",
    "detect_all": f"WITH {EVERY} SELECT container, entity_type, count(*) AS n, count(DISTINCT value) AS n_values FROM every GROUP BY container, entity_type",
    "detect_dedup": f"""WITH {DETECT}, o AS (SELECT *, start * 4 + CASE entity_type WHEN 'EMAIL_ADDRESS' THEN 0 WHEN 'CREDIT_CARD' THEN 1 ELSE 2 END AS seq FROM found)
      SELECT container, page_no, value, min(seq) AS seq, arg_max(entity_type, seq) AS entity_type FROM o GROUP BY container, page_no, value""",
    "infer_type": f"WITH {LINES} SELECT doc_id, line_no, {typed('line')} AS entity_type FROM lines",
    "allow_exact": f"""SELECT doc_id, count(*) AS n_kept FROM (SELECT doc_id, {clean("w")} AS c FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \\n]')) AS w FROM documents))
      WHERE c <> '' AND c NOT IN ('the', 'of', 'and', 'de', 'la', 'the,', 'that') GROUP BY doc_id""",
    "allow_fuzzy": f"""WITH {DETECT}, {CLEAN_FOUND}, a(term) AS (VALUES {values(("example.com", "555-1055", "be thin", "clown", "license"))})
      SELECT container, page_no, value, start, stop FROM f WHERE NOT EXISTS (SELECT 1 FROM a WHERE regexp_matches(f.clean, '(?:^|[^\\p{{L}}\\p{{N}}_])' || regexp_escape(term) || '(?:[^\\p{{L}}\\p{{N}}_]|\\z)') OR regexp_matches(term, '(?:^|[^\\p{{L}}\\p{{N}}_])' || regexp_escape(f.clean) || '(?:[^\\p{{L}}\\p{{N}}_]|\\z)'))""",
    "block_occurrences": f"WITH {PAGES}, {occurs('o', BLOCK)} SELECT * FROM o",
    "detect_occurrences": f"WITH {EVERY}, {VALUES_OF}, {occurrences('o', 'vals', ', entity_type')} SELECT * FROM o",
    "allow_protect": f"WITH {DETECT}, {occurs('o', values(('example.com', '555-1')))} SELECT * FROM found f WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.container = f.container AND o.page_no = f.page_no AND o.start < f.stop AND f.start < o.stop)",
    "candidate_union": f"WITH {CANDIDATES} SELECT priority, entity_type, count(*) AS n FROM cand GROUP BY priority, entity_type",
    "resolve_spans": f"WITH {CANDIDATES}, {resolved(False)} SELECT container, page_no, entity_type, term AS value, start, stop FROM res",
    "resolve_disjoint": f"WITH {DISJOINT} SELECT container, page_no, entity_type, term AS value, start, stop FROM res",
    "link_removal": f"""WITH {HTML}, {hits("l", "'<a\\b[^>]*>[^<]*</a>'", "h")}, {occurs("o", values(("nicht", "thedanon", "the")), "h")}
      SELECT container, page_no, value AS link, start, stop FROM l WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.container = l.container AND o.start < l.stop AND l.start < o.stop)""",
    "hit_test": f"WITH {DETECT}, points AS (SELECT DISTINCT container, page_no, (start + stop) // 2 AS x FROM found) SELECT * FROM found f WHERE EXISTS (SELECT 1 FROM points WHERE points.container = f.container AND points.page_no = f.page_no AND f.start <= x AND x < f.stop)",
    "dict_block_upsert": f"SELECT DISTINCT term, 'block' AS kind FROM (VALUES {BLOCK}, ('be thin'), ('new term')) v(term) UNION ALL SELECT term, 'allow' FROM (VALUES ('example.com'), ('555-1055'), ('clown'), ('license')) v(term)",
    "dict_allow_upsert": "SELECT DISTINCT term, 'allow' AS kind FROM (VALUES ('example.com'), ('555-1055'), ('be thin'), ('clown'), ('license'), ('other')) v(term) UNION ALL SELECT term, 'block' FROM (VALUES ('idiot'), ('pathetic'), ('worthless'), ('license')) v(term)",
    "dict_conflicts": "SELECT term FROM (VALUES ('clown'), ('license')) v(term)",
    "placeholder_assign": f"WITH {REGISTRY} SELECT * FROM registry",
    "type_counts": f"WITH {REGISTRY} SELECT container, entity_type, count(*) AS n FROM registry GROUP BY container, entity_type",
    "entry_count": f"WITH {REGISTRY} SELECT container, count(*) AS n_entries FROM registry GROUP BY container",
    "restore_payload": f"WITH {REGISTRY} SELECT container, sha256(string_agg(page_no || '|' || placeholder || '|' || original, chr(10) ORDER BY page_no, placeholder, original)) AS entries_sha256 FROM registry GROUP BY container",
    "metadata_scrub": "SELECT page_id, sha256(regexp_replace(html, '(?s)<title>.*?</title>|<meta\\b[^>]*>', '', 'g')) AS clean_sha256 FROM pages",
    "widget_drop": "SELECT page_id, sha256(html || '<form></form>') AS clean_sha256 FROM pages",
    "image_mask": "SELECT page_id, CAST(0 AS INTEGER) AS start, CAST(11 AS INTEGER) AS stop, '[ IMMAGINE RIMOSSA ]' AS original FROM pages",
    "leak_check": f"""WITH {DETECT}, n AS (SELECT DISTINCT container, value AS needle FROM found WHERE entity_type = 'EMAIL_ADDRESS'),
      k AS (SELECT n.container, needle, CAST(CASE WHEN contains(lower(n.container), lower(needle)) THEN 1 ELSE 0 END AS BIGINT) AS n_metadata, count_if(contains(lower(text), lower(needle))) AS n_pages FROM n JOIN p ON p.container = n.container GROUP BY n.container, needle)
      SELECT container, needle, n_metadata, CAST(n_pages AS BIGINT) AS n_pages, CAST(n_pages > 0 AS BIGINT) AS raw_hit, CAST(n_metadata + n_pages + CAST(n_pages > 0 AS BIGINT) AS BIGINT) AS alerts, CASE WHEN n_metadata + n_pages > 0 THEN 'VULNERABLE' ELSE 'SECURE' END AS verdict FROM k""",
    "leftovers": f"WITH {REGISTRY} SELECT p.container, p.page_no, g.placeholder FROM registry g JOIN p ON p.container = g.container AND contains(lower(p.text), lower(g.original)) WHERE g.entity_type = 'EMAIL_ADDRESS'",
    "manual_redact": f"""WITH {PAGES}, {MARKS}, x AS (SELECT *, {collapse("substr(text, start + 1, stop - start)")} AS o FROM m)
      SELECT container, page_no, start, stop, CASE WHEN o = '' THEN '[ IMMAGINE RIMOSSA ]' ELSE o END AS original, CASE WHEN o = '' THEN 'IMAGE' ELSE {typed("o")} END AS entity_type, 'manual' AS origin FROM x""",
    "redaction_rows": f"WITH {CANDIDATES}, {resolved(False)} SELECT container, page_no, start, stop, '{{\"mark\":1,\"original\":\"' || {collapse('term')} || '\",\"entity_type\":\"' || entity_type || '\"}}' AS content FROM res",
    "payload_read": f"WITH {CANDIDATES}, {resolved(False)} SELECT container, page_no, start, stop, CASE WHEN start % 3 = 2 THEN {collapse('term')} END AS original, CASE WHEN start % 3 = 2 THEN entity_type END AS entity_type FROM res",
    "review_remove": f"WITH {DETECT} SELECT container, page_no, entity_type, start, stop FROM found f WHERE NOT EXISTS (SELECT 1 FROM found c WHERE c.entity_type = 'CREDIT_CARD' AND c.container = f.container AND c.page_no = f.page_no AND f.start <= c.start + 3 AND c.start + 3 < f.stop)",
    "review_clear": f"WITH {DETECT} SELECT container, page_no, entity_type, start, stop FROM found WHERE NOT (container = 'src3' AND page_no = 43)",
    "redact_plan": f"WITH {PLAN} SELECT container, page_no, priority, term, start, stop, entity_type FROM res",
}
