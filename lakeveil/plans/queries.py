"""The library's queries over the driver's tables. Dictionaries and marks are inline, so that SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed import IMAGE_LABEL, SHORTEST_BOX
from ..functions import boxes, text
from ..operators import detect, export, registry, review, spans, vault, verify
from ..sources import dictionaries, pages

BLOCK_TERMS = ("idiot", "pathetic", "worthless", "clown", "license")
ALLOW_TERMS = ("example.com", "555-1055", "be thin", "clown", "license")
NAMES = (("Theaea", "PERSON"), ("Onthan", "PERSON"), ("Zu", "LOCATION"), ("Heitü", "LOCATION"), ("Éréier", "PERSON"))


def inline(spark: SparkSession, rows, schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def terms(spark: SparkSession, words) -> DataFrame:
    return inline(spark, ((w,) for w in words), "term string")


def document_pages(spark: SparkSession, d: str) -> DataFrame:
    return pages.document_pages(pages.read(spark, d, "documents"))


def document_lines(spark: SparkSession, d: str) -> DataFrame:
    docs = pages.read(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def patterns(p: DataFrame) -> DataFrame:
    return detect.emails(p).unionByName(detect.cards(p)).unionByName(detect.phones(p))


def detections(p: DataFrame) -> DataFrame:
    """All classes, names and places by the lexicon."""
    return detect.detect(p, names=inline(p.sparkSession, NAMES, "term string, entity_type string"))


def candidates(p: DataFrame) -> DataFrame:
    """All detections, in the order of their types."""
    order = F.array_position(F.lit(list(detect.ORDER)), F.col("entity_type")).cast("int") + 9
    return detections(p).select("container", "page_no", order.alias("priority"), F.col("value").alias("term"), "start", "end", "entity_type")


def blocked(p: DataFrame) -> DataFrame:
    """Candidates by the block dictionary."""
    found = spans.occurrences(p, terms(p.sparkSession, BLOCK_TERMS), as_written=True).withColumns({"priority": F.lit(spans.BLOCK), "entity_type": text.infer_type(F.col("term"))})
    return found.select("container", "page_no", "priority", "term", "start", "end", "entity_type")


def accepted(p: DataFrame, disjoint: bool) -> DataFrame:
    return spans.resolve(candidates(p).unionByName(blocked(p)), disjoint).select("container", "page_no", "entity_type", F.col("term").alias("value"), "start", "end")


def end_named(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("end", "stop")


# scans and sources


def src_accept(spark, d):
    p = pages.read(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 7 == 0, "").when(F.col("page_id") % 3 == 0, F.concat(F.regexp_replace("url", "[?#].*", ""), F.lit(".PDF"))).otherwise(F.col("url")).alias("path"))
    return p.select("page_id", "path", pages.accepted(F.col("path")).alias("refused"))


def page_scan(spark, d):
    return document_pages(spark, d).groupBy("container").agg(F.count("*").alias("n_pages"), F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page"), F.sum(F.length("text")).alias("n_chars"))


def page_text_html(spark, d):
    return pages.markup_pages(pages.read(spark, d, "pages")).select("container", "text", "extract_error")


def dialogue_scan(spark, d):
    return pages.dialogue_pages(pages.read(spark, d, "conversations")).groupBy("container").agg(F.count("*").alias("n_pages"), F.sum(F.length("text")).alias("n_chars"))


def span_text(spark, d):
    docs = pages.read(spark, d, "documents")
    return docs.select("doc_id", text.strip(F.substring("text", 11, 30)).alias("span"))


def ocr_need(spark, d):
    docs = pages.read(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 11 == 0, F.regexp_replace("text", "e", "�")).otherwise(F.when(F.col("doc_id") % 13 == 0, F.substring("text", 1, 12)).otherwise(F.col("text"))).alias("text"), F.when(F.col("doc_id") % 5 > 0, F.col("doc_id") % 2).alias("images"))
    return docs.select("doc_id", pages.needs_ocr(F.col("text"), F.col("images")).alias("needed"))


def scanned_preview(spark, d):
    p = document_pages(spark, d).select("container", "page_no", F.when(F.col("page_no") % 3 == 0, F.lit(" \n")).otherwise(F.col("text")).alias("text"), (F.col("page_no") % 2).alias("images"))
    return pages.scanned_preview(p)


def first_match(spark, d):
    rows = [(0, "/from/environment", False), (1, "/from/library", True), (2, "/from/bundle", True)]
    return pages.first_match(inline(spark, rows, "ord int, path string, found boolean"))


def ocr_lang(spark, d):
    rows = inline(spark, [(0, ["eng"]), (1, ["eng", "ita"]), (2, ["deu"])], "id int, installed array<string>")
    return rows.select("id", pages.ocr_codes("EN", None).alias("en"), pages.ocr_codes("IT", F.col("installed")).alias("it"), pages.ocr_codes("BOTH", F.col("installed")).alias("two"))


def dict_load(spark, d):
    return dictionaries.terms(document_lines(spark, d).select(F.explode(F.split("line", " ")).alias("value")))


def dict_save(spark, d):
    return dictionaries.as_lines(pages.read(spark, d, "customer").select(F.col("c_mktsegment").alias("term")))


def doc_digest(spark, d):
    return pages.read(spark, d, "documents").select("doc_id", vault.digest(F.col("text")).alias("sha256"))


def leak_raw(spark, d):
    files = pages.read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return verify.raw_hits(files, "Example.com")


# projections and filters


def clean_form(spark, d):
    return document_lines(spark, d).select("doc_id", "line_no", text.clean_form(F.col("line")).alias("clean"))


def entity_filter(spark, d):
    found = detect.detect(document_pages(spark, d), ("EMAIL_ADDRESS", "CREDIT_CARD"))
    return found.groupBy("entity_type").agg(F.count("*").alias("n"))


def lang_expand(spark, d):
    return pages.passes(document_pages(spark, d), "BOTH").groupBy("language", "pass").agg(F.count("*").alias("n_pages"))


def line_boxes(spark, d):
    li = pages.read(spark, d, "lineitem")
    q, k = F.col("l_quantity"), F.col("l_linenumber").cast("double")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", boxes.box(q, k, F.col("l_quantity") + (F.col("l_partkey") % 17).cast("double"), k * 3).alias("a"), boxes.box(F.lit(20.0), F.lit(4.0), F.lit(30.0), F.lit(9.0)).alias("b"))


def min_box(spark, d):
    return line_boxes(spark, d).where(boxes.big_enough(F.col("a"), SHORTEST_BOX)).select("l_orderkey", "l_linenumber", "l_partkey")


def unscale(spark, d):
    rows = line_boxes(spark, d).select("l_orderkey", "l_linenumber", boxes.unscaled(F.col("a"), F.greatest(F.lit(0.5), F.least(F.lit(4.0), F.col("l_partkey") / 64))).alias("u"))
    return rows.groupBy((F.col("l_orderkey") % 100).alias("bucket")).agg(F.round(F.sum("u.x0"), 3).alias("x0"), F.round(F.sum("u.y1"), 3).alias("y1"), F.count("*").alias("n"))


def rect_ops(spark, d):
    a, b = F.col("a"), F.col("b")
    x, y = (a["x0"] + a["x1"]) / 2, (a["y0"] + a["y1"]) / 2
    return line_boxes(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", boxes.intersects(a, b).alias("meets"), boxes.contains(b, x, y).alias("centred"))


def normalize_type(spark, d):
    return pages.read(spark, d, "part").select(F.col("p_type").alias("raw")).distinct().select("raw", text.entity_name(F.col("raw")).alias("name"))


def escape_html(spark, d):
    return pages.read(spark, d, "pages").select("page_id", F.sha2(text.escape_html(F.col("html")), 256).alias("escaped_sha256"))


def log_severity(spark, d):
    says = F.when(F.col("event_id") % 5 == 0, "ERRORE: ").when(F.col("event_id") % 5 == 1, "Avviso ").when(F.col("event_id") % 5 == 2, "Esportazione completata ").otherwise("")
    lines = pages.read(spark, d, "events").select(F.concat(says, "event_type").alias("line"))
    return lines.groupBy(text.log_severity(F.col("line")).alias("severity")).agg(F.count("*").alias("n"))


def progress_pct(spark, d):
    li = pages.read(spark, d, "lineitem").select(F.col("l_linenumber").alias("done"), (F.col("l_orderkey") % 8).alias("total"))
    return li.groupBy("done", "total").agg(F.count("*").alias("n")).select("done", "total", "n", text.progress(F.col("done"), F.col("total")).alias("percent"))


# detection


def detect_email(spark, d):
    return end_named(detect.emails(document_pages(spark, d)))


def detect_phone(spark, d):
    return end_named(detect.phones(document_pages(spark, d)))


def detect_card(spark, d):
    return end_named(detect.cards(document_pages(spark, d)))


def detect_iban(spark, d):
    rows = [("x", 1, "pay DE89370400440532013000 now"), ("x", 2, "bad DE89370400440532013001"), ("y", 3, "GB82WEST12345698765432, FR1420041010050500013M02606."), ("y", 4, "in groups DE89 3704 0044 0532 0130 00 and GB82 WEST 1234 5698 7654 32")]
    return end_named(detect.ibans(document_pages(spark, d).unionByName(inline(spark, rows, pages.PAGES))))


def detect_crypto(spark, d):
    rows = [("x", 1, "to 1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa or 1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNb"), ("y", 2, "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4 and more")]
    return end_named(detect.crypto(document_pages(spark, d).unionByName(inline(spark, rows, pages.PAGES))))


def detect_lexicon(spark, d):
    return end_named(detect.lexicon(document_pages(spark, d), inline(spark, NAMES, "term string, entity_type string")))


def detect_all(spark, d):
    return detections(document_pages(spark, d)).groupBy("container", "entity_type").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_values"))


def detect_dedup(spark, d):
    order = F.when(F.col("entity_type") == "EMAIL_ADDRESS", 0).when(F.col("entity_type") == "CREDIT_CARD", 1).otherwise(2)
    found = patterns(document_pages(spark, d)).withColumn("seq", F.col("start") * 4 + order)
    return detect.per_value(found)


def infer_type(spark, d):
    return document_lines(spark, d).select("doc_id", "line_no", text.infer_type(F.col("line")).alias("entity_type"))


# dictionaries and joins


def allow_exact(spark, d):
    docs = document_lines(spark, d).select("doc_id", F.explode(F.split("line", " ")).alias("value"))
    kept = detect.allowed_exactly(docs, terms(spark, ("the", "of", "and", "de", "la", "the,", "that")))
    return kept.groupBy("doc_id").agg(F.count("*").alias("n_kept"))


def allow_fuzzy(spark, d):
    found = patterns(document_pages(spark, d)).withColumn("clean", text.clean_form(F.col("value")))
    return end_named(detect.allowed_fuzzily(found, terms(spark, ALLOW_TERMS)).select("container", "page_no", "value", "start", "end"))


def block_occurrences(spark, d):
    return end_named(spans.occurrences(document_pages(spark, d), terms(spark, BLOCK_TERMS)))


def values_of(found: DataFrame) -> DataFrame:
    return found.select("container", "page_no", F.col("value").alias("term"), "entity_type").distinct()


def detect_occurrences(spark, d):
    p = document_pages(spark, d)
    return end_named(spans.occurrences(p, values_of(detections(p)), on_page=True))


def allow_protect(spark, d):
    p = document_pages(spark, d)
    return end_named(spans.protect(patterns(p), spans.occurrences(p, terms(spark, ("example.com", "555-1")))).select("container", "page_no", "entity_type", "value", "start", "end"))


def candidate_union(spark, d):
    p = document_pages(spark, d)
    return candidates(p).unionByName(blocked(p)).groupBy("priority", "entity_type").agg(F.count("*").alias("n"))


def resolve_spans(spark, d):
    return end_named(accepted(document_pages(spark, d), disjoint=False))


def resolve_disjoint(spark, d):
    return end_named(accepted(document_pages(spark, d), disjoint=True))


def page_links(spark, d):
    rows = pages.read(spark, d, "pages").select(F.col("page_id").cast("string").alias("container"), F.lit(0).cast("bigint").alias("page_no"), F.col("html").alias("text"))
    links = rows.select("container", "page_no", F.explode(export.links(F.col("text"))).alias("x")).select("container", "page_no", F.col("x.text").alias("link"), F.col("x.start").cast("bigint").alias("start"), F.col("x.end").cast("bigint").alias("end"))
    return rows, links


def link_removal(spark, d):
    rows, links = page_links(spark, d)
    marked = spans.occurrences(rows, terms(spark, ("nicht", "thedanon", "the")))
    return end_named(spans.touching(links, marked, keep=True))


def hit_test(spark, d):
    """Findings hit by a point in the middle of each, wherever on the page it lies."""
    found = patterns(document_pages(spark, d))
    points = found.select("container", "page_no", F.floor((F.col("start") + F.col("end")) / 2).alias("at")).distinct()
    return end_named(spans.at_point(found, points))


def dict_block_upsert(spark, d):
    block, allow = dictionaries.move(terms(spark, BLOCK_TERMS), terms(spark, ALLOW_TERMS), terms(spark, ("be thin", "ab", "new term")))
    return block.withColumn("kind", F.lit("block")).unionByName(allow.withColumn("kind", F.lit("allow")))


def dict_allow_upsert(spark, d):
    allow, block = dictionaries.move(terms(spark, ALLOW_TERMS), terms(spark, BLOCK_TERMS), terms(spark, ("clown", "other")))
    return block.withColumn("kind", F.lit("block")).unionByName(allow.withColumn("kind", F.lit("allow")))


def dict_conflicts(spark, d):
    return dictionaries.conflicts(terms(spark, BLOCK_TERMS), terms(spark, ALLOW_TERMS))


# registry and exports


def assigned(p: DataFrame) -> DataFrame:
    return registry.assign(accepted(p, disjoint=True))


def placeholder_assign(spark, d):
    return assigned(document_pages(spark, d))


def type_counts(spark, d):
    return assigned(document_pages(spark, d)).groupBy("container", "entity_type").agg(F.count("*").alias("n"))


def entry_count(spark, d):
    return assigned(document_pages(spark, d)).groupBy("container").agg(F.count("*").alias("n_entries"))


def restore_payload(spark, d):
    """Digests of the entries as the payloads hold them."""
    found = assigned(document_pages(spark, d))
    no_file = F.lit(None).cast("string")
    payloads = vault.payloads(found, found.select("container").distinct().withColumns({"source_sha256": no_file, "output_sha256": no_file}))
    entries = F.from_json("payload", "entries array<struct<page_no:bigint,placeholder:string,original:string>>")["entries"]
    lines = F.transform("e", lambda x: F.concat_ws("|", x["page_no"].cast("string"), x["placeholder"], x["original"]))
    return payloads.select("container", entries.alias("e")).select("container", F.sha2(F.array_join(lines, "\n"), 256).alias("entries_sha256"))


def export_pseudonymize(spark, d):
    p = document_pages(spark, d)
    found = accepted(p, disjoint=True)
    return export.export("pseudonymize", p, registry.lookup(found, registry.assign(found)))


def export_anonymize(spark, d):
    p = document_pages(spark, d)
    return export.export("anonymize", p, candidates(p).unionByName(blocked(p)))


def restore_roundtrip(spark, d):
    p = document_pages(spark, d)
    found = accepted(p, disjoint=True)
    names = registry.assign(found)
    hidden = export.pseudonymize(p, registry.lookup(found, names))
    back = export.restore(hidden, names)
    return back.join(p.select("container", "page_no", F.col("text").alias("was")), ["container", "page_no"]).select("container", "page_no", (F.col("text") == F.col("was")).alias("same"))


def metadata_scrub(spark, d):
    return pages.read(spark, d, "pages").select("page_id", F.sha2(export.without_metadata(F.col("html")), 256).alias("clean_sha256"))


def widget_drop(spark, d):
    form = F.concat(F.col("html"), F.lit("<form><input name=a><select><option>x</select></form>"))
    return pages.read(spark, d, "pages").select("page_id", F.sha2(export.without_widgets(form), 256).alias("clean_sha256"))


def image_mask(spark, d):
    html = F.concat(F.lit("<img src=x>"), F.col("html"))
    return pages.read(spark, d, "pages").select("page_id", F.explode(export.images(html)).alias("x")).select("page_id", F.col("x.start").alias("start"), F.col("x.end").alias("stop"), F.lit(IMAGE_LABEL).alias("original"))


def leak_check(spark, d):
    p = document_pages(spark, d)
    needles = detect.emails(p).select("container", F.col("value").alias("needle")).distinct()
    files = p.select("container", F.encode("text", "UTF-8").alias("content"))
    return verify.leak_check(p, p.select("container", F.col("container").alias("value")).distinct(), needles, files)


def leftovers(spark, d):
    p = document_pages(spark, d)
    return verify.leftovers(p, assigned(p).where("entity_type = 'EMAIL_ADDRESS'"))


# review


def marks(p: DataFrame) -> DataFrame:
    return p.select("container", "page_no", F.explode(F.array(*(F.struct(F.lit(a).cast("bigint").alias("start"), F.lit(b).cast("bigint").alias("end")) for a, b in ((0, 9), (20, 44), (100000000, 100000009))))).alias("x")).select("container", "page_no", "x.*")


def manual_redact(spark, d):
    p = document_pages(spark, d)
    return end_named(review.manual(p, marks(p)))


def redaction_rows(spark, d):
    found = accepted(document_pages(spark, d), disjoint=False)
    return end_named(found.select("container", "page_no", "start", "end", review.payload(F.col("value"), F.col("entity_type")).alias("content")))


def payload_read(spark, d):
    found = accepted(document_pages(spark, d), disjoint=False)
    content = F.when(F.col("start") % 3 == 0, F.lit('{"mark":2,"original":"x"}')).when(F.col("start") % 3 == 1, F.lit("no json")).otherwise(review.payload(F.col("value"), F.col("entity_type")))
    got = review.read_payload(F.col("content"))
    return end_named(found.withColumn("content", content).select("container", "page_no", "start", "end", got["original"].alias("original"), got["entity_type"].alias("entity_type")))


def review_remove(spark, d):
    p = document_pages(spark, d)
    found = patterns(p)
    points = found.where("entity_type = 'CREDIT_CARD'").select("container", "page_no", (F.col("start") + 3).alias("at"))
    return end_named(review.remove_at(found, points).select("container", "page_no", "entity_type", "start", "end"))


def review_clear(spark, d):
    return end_named(review.clear_page(patterns(document_pages(spark, d)), "src3", 43).select("container", "page_no", "entity_type", "start", "end"))


def redact_plan(spark, d):
    """Block terms, then detections that no allowed span protects, resolved by priority."""
    p = document_pages(spark, d)
    found = spans.occurrences(p, values_of(detections(p)), on_page=True)
    return end_named(spans.plan(blocked(p), found, spans.occurrences(p, terms(spark, ("mail5.example.com",)))))


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {f.__name__: f for f in (
    export_pseudonymize, export_anonymize, restore_roundtrip, src_accept, page_scan, page_text_html, dialogue_scan, span_text, ocr_need, scanned_preview, first_match, ocr_lang,
    dict_load, dict_save, doc_digest, leak_raw, clean_form, entity_filter, lang_expand, min_box, unscale, rect_ops, normalize_type, escape_html, log_severity, progress_pct,
    detect_email, detect_phone, detect_card, detect_iban, detect_crypto, detect_lexicon, detect_all, detect_dedup, infer_type, allow_exact, allow_fuzzy, block_occurrences,
    detect_occurrences, allow_protect, candidate_union, resolve_spans, resolve_disjoint, link_removal, hit_test, dict_block_upsert, dict_allow_upsert, dict_conflicts,
    placeholder_assign, type_counts, entry_count, restore_payload, metadata_scrub, widget_drop, image_mask, leak_check, leftovers, manual_redact, redaction_rows, payload_read,
    review_remove, review_clear, redact_plan,
)}
