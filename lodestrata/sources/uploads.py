"""Uploaded files: what is taken in, pages with too little text, and what recognition puts in their place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.config import DEFAULTS, Settings
from lodestrata.functions.text import strip
from lodestrata.operators.provider import Provider, recognise
from lodestrata.session import materialize


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content of PDF files below a folder; conditions on length reach the scan."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "true").load(path)


def uploads_of(files: DataFrame) -> DataFrame:
    """doc_id (a hash of the path), filename, content_type (unknown), content of files as :func:`read_files` gives them."""
    return files.select(F.xxhash64("path").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("filename"), F.lit(None).cast("string").alias("content_type"), "content")


def validate(uploads: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """``uploads`` (filename, content_type, content) with filename filled in, error (null: taken in) and candidate (it was a PDF at all)."""
    kind, content = F.lower(F.coalesce("content_type", F.lit(""))), F.coalesce("content", F.lit(b""))
    is_pdf = F.substring(content, 1, 5) == F.lit(b"%PDF-")
    error = (
        F.when((kind != "") & ~kind.contains("pdf"), F.lit("file is not a pdf"))
        .when(~is_pdf, F.lit("not a valid PDF"))
        .when(F.length(content) > settings.max_pdf_bytes, F.lit(f"file exceeds {settings.max_pdf_bytes} byte limit"))
    )
    name = F.when(F.length("filename") > 0, F.col("filename")).otherwise(F.lit("unnamed.pdf"))
    return uploads.withColumn("filename", name).withColumn("error", error).withColumn("candidate", is_pdf & ((kind == "") | kind.contains("pdf")))


def outcome(results: DataFrame) -> DataFrame:
    """ingested, skipped, failed (counts of ``results``: status, candidate) and http: 400 only where no PDF came and all failed."""
    counts = results.agg(
        F.count(F.when(F.col("status") == "ready", 1)).alias("ingested"),
        F.count(F.when(F.col("status") == "skipped", 1)).alias("skipped"),
        F.count(F.when(F.col("status") == "failed", 1)).alias("failed"),
        F.coalesce(F.bool_or("candidate"), F.lit(False)).alias("any_pdf"),
    )
    return counts.select("ingested", "skipped", "failed", F.when(~F.col("any_pdf") & (F.col("failed") > 0) & (F.col("ingested") + F.col("skipped") == 0), 400).otherwise(200).alias("http"))


def low_text(pages: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """``pages`` (doc_id, page_num, raw_text) with low: too little text to be digital."""
    return pages.withColumn("low", F.length(strip(F.coalesce("raw_text", F.lit("")))) < settings.low_text_chars)


def ocr_plan(pages: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """doc_id, pages, low_pages, plan: none, whole (all pages in one call), or per_page (the low ones)."""
    counts = low_text(pages, settings).groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if("low").alias("low_pages"))
    return counts.withColumn("plan", F.when(F.col("low_pages") == 0, "none").when(F.col("low_pages") == F.col("pages"), "whole").otherwise("per_page"))


def split_recognised(whole: DataFrame) -> DataFrame:
    """doc_id, page_num, ocr_text, fits of recognised documents (doc_id, pages, ocr_text): a text a page where form feeds give as many as pages.
    Where they don't, fits is false and pages are to be recognised one by one; a single page isn't split."""
    parts = F.when(F.col("pages") == 1, F.array("ocr_text")).otherwise(F.split("ocr_text", "\f"))
    rows = whole.withColumn("parts", parts).withColumn("fits", F.size("parts") == F.col("pages"))
    return rows.select("doc_id", "fits", F.posexplode("parts").alias("at", "ocr_text")).select("doc_id", (F.col("at") + 1).alias("page_num"), "ocr_text", "fits")


def replace_pages(blocks: DataFrame, recognised: DataFrame) -> DataFrame:
    """``blocks`` in which recognised pages (doc_id, page_num, ocr_text) are one block of a whole page; an empty text changes nothing."""
    some = recognised.where(strip(F.coalesce("ocr_text", F.lit(""))) != "")
    box = F.struct(*(F.lit(v).alias(k) for k, v in (("x0", 0.0), ("y0", 0.0), ("x1", 612.0), ("y1", 792.0))))
    new = some.select("doc_id", "page_num", F.lit(0).alias("pos"), F.col("ocr_text").alias("text"), box.alias("bbox"), F.lit(11.0).alias("font_size"))
    return blocks.join(some, ["doc_id", "page_num"], "left_anti").unionByName(new)


def recognised_pages(pages: DataFrame, files: DataFrame, provider: Provider, settings: Settings = DEFAULTS) -> DataFrame:
    """doc_id, page_num, ocr_text of pages with too little text. A file whose pages all have too little goes to recognition once, as a whole; if
    what comes back doesn't part into its pages, and for files with some such pages, each of these goes by itself.

    ``pages``: doc_id, page_num, raw_text, image. ``files``: doc_id, content. Texts are written down, so no page is sent twice.
    """
    plan = ocr_plan(pages, settings)
    whole = plan.where("plan = 'whole'").join(files.select("doc_id", "content"), "doc_id")
    parted = materialize(split_recognised(recognise(whole, "content", provider).select("doc_id", "pages", F.coalesce("ocr_text", F.lit("")).alias("ocr_text"))), "recognised")
    single = plan.where("plan = 'per_page'").select("doc_id").unionByName(parted.where("not fits").select("doc_id").distinct())
    low = low_text(pages, settings).where("low").join(single, "doc_id", "left_semi").select("doc_id", "page_num", "image")
    one = materialize(recognise(low, "image", provider).select("doc_id", "page_num", "ocr_text"), "recognised-pages")
    return parted.where("fits").select("doc_id", "page_num", "ocr_text").unionByName(one).where(strip(F.coalesce("ocr_text", F.lit(""))) != "")


def parse_pdf(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks, pages) of PDF files (doc_id, content): a block for each line of the layout, a row for each page with its text and, for
    recognition, the page as a file of its own. It needs a layout parser, which isn't part of this package."""
    try:
        import pymupdf  # noqa: F401
    except ImportError as e:
        raise NotImplementedError("no PDF layout parser is installed; give another one, or blocks and pages instead") from e
    from lodestrata.schemas import BLOCKS

    def lines(batches):
        import pandas as pd
        import pymupdf

        for batch in batches:
            rows = []
            for doc, content in zip(batch["doc_id"], batch["content"]):
                for number, page in enumerate(pymupdf.open(stream=bytes(content)), 1):
                    pos = 0
                    for line in (x for b in page.get_text("dict")["blocks"] if b["type"] == 0 for x in b["lines"]):
                        spans = line["spans"]
                        text = " ".join(s["text"] for s in spans).strip()
                        if text:
                            size = sum(s["size"] for s in spans) / len(spans) * (DEFAULTS.bold_ratio if any("Bold" in s["font"] for s in spans) else 1)
                            rows.append((doc, number, pos, text, dict(zip(("x0", "y0", "x1", "y1"), line["bbox"])), size))
                            pos += 1
            yield pd.DataFrame(rows, columns=BLOCKS.fieldNames())

    def each_page(batches):
        import pandas as pd
        import pymupdf

        for batch in batches:
            rows = []
            for doc, content in zip(batch["doc_id"], batch["content"]):
                source = pymupdf.open(stream=bytes(content))
                for number, page in enumerate(source, 1):
                    alone = pymupdf.open()
                    alone.insert_pdf(source, from_page=number - 1, to_page=number - 1)
                    rows.append((doc, number, page.get_text(), alone.tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "page_num", "raw_text", "image"])

    some = files.select("doc_id", "content")
    return some.mapInPandas(lines, BLOCKS), some.mapInPandas(each_page, "doc_id bigint, page_num int, raw_text string, image binary")
