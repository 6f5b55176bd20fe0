"""Pages of text: where they come from, which are accepted, what has to be recognised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixed import OCR_CODES, OCR_NOISE, OCR_TEXT, SCAN_LANGUAGES
from ..functions.text import html_text, strip

PAGES = "container string, page_no bigint, text string"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_pages(documents: DataFrame) -> DataFrame:
    """Pages (container, page_no, text): a source is a container, its documents are the pages."""
    return documents.select(F.col("source").alias("container"), F.col("doc_id").alias("page_no"), "text")


def dialogue_pages(conversations: DataFrame) -> DataFrame:
    return conversations.select(F.col("conv_id").cast("string").alias("container"), F.col("turn").alias("page_no"), "text")


def markup_pages(pages: DataFrame) -> DataFrame:
    """Pages of markup; a page whose text can't be read keeps its row and says so."""
    text = html_text(F.col("html"))
    return pages.select(F.col("page_id").cast("string").alias("container"), F.lit(0).cast("bigint").alias("page_no"), F.coalesce(text, F.lit("")).alias("text"), F.when(F.col("html").isNull(), "no text").alias("extract_error"))


def accepted(path: Column) -> Column:
    """Why a path is refused, or null: empty, or no PDF by its ending."""
    return F.when(path.isNull() | (strip(path) == ""), "empty").when(~F.lower(path).endswith(".pdf"), "not a pdf")


def exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(there)


def open_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder or pattern (path, content, refused): refused by name, or as locked by a password (an /Encrypt entry). A path without files is an error."""
    if not (path or "").strip():
        raise ValueError("a path is needed")
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    locked = F.contains(F.col("content"), F.lit(b"/Encrypt"))
    return files.withColumn("refused", F.coalesce(accepted(F.col("path")), F.when(locked, "password-protected")))


def find_data(spark: SparkSession, folders: list[str], ending: str = ".traineddata") -> str | None:
    """The first folder, in the order given, that holds a file with this ending."""
    for folder in folders:
        if not folder or not exists(spark, folder):
            continue
        there = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        if any(f.getPath().getName().endswith(ending) for f in fs.listStatus(there)):
            return folder
    return None


def page_number(entry: Column, n_pages: Column) -> Column:
    """What was typed as a page (from 1) as a place from 0; null if it is no whole number or there is no such page."""
    number = strip(entry).try_cast("int")
    return F.when(number.between(1, n_pages), number - 1)


def needs_ocr(text: Column, images: Column) -> Column:
    """images: how many, null if they can't be read."""
    n = F.length(strip(text))
    noise = (F.length(text) - F.length(F.replace(text, F.lit("�"), F.lit("")))) / F.greatest(F.length(text), F.lit(1))
    return F.when((n >= OCR_TEXT) & (noise < OCR_NOISE), False).when(images > 0, True).otherwise(n < OCR_TEXT)


def scanned_preview(pages: DataFrame, most: int = 10) -> DataFrame:
    """One row a container with scanned pages (no text, but images): their count and the first page numbers, from 1."""
    scanned = pages.where((strip(F.col("text")) == "") & (F.col("images") > 0))
    first = Window.partitionBy("container").orderBy("page_no")
    rows = scanned.withColumn("k", F.row_number().over(first)).groupBy("container").agg(
        F.count("*").alias("n_scanned"), F.sort_array(F.collect_list(F.when(F.col("k") <= most, F.col("page_no") + 1))).alias("shown")
    )
    shown = F.array_join(F.transform("shown", lambda x: x.cast("string")), ", ")
    return rows.select("container", "n_scanned", F.when(F.col("n_scanned") > most, F.concat(shown, F.lit("..."))).otherwise(shown).alias("preview"))


def first_match(candidates: DataFrame) -> DataFrame:
    """The first place (ord) that has what is looked for (found); no row if none has."""
    return candidates.where("found").groupBy().agg(F.min_by("path", "ord").alias("path")).where("path is not null")


def ocr_codes(choice: str, installed: Column | None) -> Column:
    """Recognition languages joined by +; those installed, or all if none of them is."""
    if choice not in OCR_CODES:
        raise ValueError(f"language {choice!r} is not one of {', '.join(OCR_CODES)}")
    wanted = F.array(*map(F.lit, OCR_CODES[choice]))
    if installed is None:
        return F.array_join(wanted, "+")
    there = F.filter(wanted, lambda x: F.array_contains(installed, x))
    return F.array_join(F.when(F.size(there) > 0, there).otherwise(wanted), "+")


def passes(pages: DataFrame, choice: str) -> DataFrame:
    """A row for each page and scan language."""
    if choice not in SCAN_LANGUAGES:
        raise ValueError(f"language {choice!r} is not one of {', '.join(SCAN_LANGUAGES)}")
    return pages.select("*", F.posexplode(F.array(*map(F.lit, SCAN_LANGUAGES[choice]))).alias("pass", "language"))


def recognise(pages: DataFrame, engine) -> DataFrame:
    """Text of pages that need recognition, by a plugged-in function from a batch of texts and image counts to texts.

    Pages that don't need it never reach the engine: the two kinds are split and put together again.
    """
    need = F.coalesce(needs_ocr(F.col("text"), F.col("images")), F.lit(True))

    def run(batches):
        for pdf in batches:
            pdf["text"] = list(engine(pdf["text"].tolist(), pdf["images"].tolist()))
            yield pdf

    todo, rest = pages.where(need), pages.where(~need)
    return todo.mapInPandas(run, pages.schema).withColumn("source", F.lit("ocr")).unionByName(rest.withColumn("source", F.lit("text")))
