"""From blocks of a page's layout to chunks: sections, their boxes, token windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.config import DEFAULTS, Settings
from lodestrata.functions.text import strip, words

#: Pages of a document that are put in order together.
PAGES = 64


def body_size(blocks: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """doc_id, page_num, body: the font size (to the nearest even half) that most text has; the first seen wins ties, none gives the default."""
    size = F.bround("font_size")
    per = blocks.where("font_size > 0").groupBy("doc_id", "page_num", size.alias("size")).agg(F.sum(F.length("text")).alias("n"), F.min("pos").alias("first"))
    best = per.groupBy("doc_id", "page_num").agg(F.max_by("size", F.struct("n", -F.col("first"))).alias("body"))
    return blocks.select("doc_id", "page_num").distinct().join(best, ["doc_id", "page_num"], "left").select("doc_id", "page_num", F.coalesce("body", F.lit(settings.default_body_size)).alias("body"))


def sections(blocks: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """doc_id, page_num, section, text, bbox, section_title: runs of blocks up to the next heading of a page.

    The title is the last heading's text, carried on across pages, and taken up also from sections that are blank and drop out. Sections are put
    in order within PAGES pages; of each such part of a document one title goes on to the next.
    """
    sized = blocks.join(body_size(blocks, settings), ["doc_id", "page_num"]).withColumn("heading", (F.col("font_size") >= settings.heading_ratio * F.col("body")).cast("int"))
    on_page = Window.partitionBy("doc_id", "page_num").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    grouped = sized.withColumn("section", F.sum("heading").over(on_page))
    item = F.struct("pos", "text", "heading")
    joined = grouped.groupBy("doc_id", "page_num", "section").agg(
        F.array_sort(F.collect_list(item)).alias("items"),
        F.struct(F.min("bbox.x0").alias("x0"), F.min("bbox.y0").alias("y0"), F.max("bbox.x1").alias("x1"), F.max("bbox.y1").alias("y1")).alias("bbox"),
    )
    head = F.when(F.col("items")[0]["heading"] == 1, F.col("items")[0]["text"])
    joined = joined.withColumn("own", F.when(F.length(strip(head)) > 0, strip(head))).withColumn("text", strip(F.array_join(F.transform("items", lambda x: x["text"]), " ")))
    joined = joined.withColumn("stretch", F.floor(F.col("page_num") / PAGES))
    so_far = Window.partitionBy("doc_id", "stretch").orderBy("page_num", "section").rowsBetween(Window.unboundedPreceding, 0)
    ends = joined.where("own is not null").groupBy("doc_id", "stretch").agg(F.max_by("own", F.struct("page_num", "section")).alias("ended"))
    before = Window.partitionBy("doc_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    ends = joined.select("doc_id", "stretch").distinct().join(ends, ["doc_id", "stretch"], "left").withColumn("begun", F.last("ended", ignorenulls=True).over(before)).select("doc_id", "stretch", "begun")
    titled = joined.withColumn("titled", F.last("own", ignorenulls=True).over(so_far)).join(ends, ["doc_id", "stretch"]).withColumn("section_title", F.coalesce("titled", "begun"))
    return titled.where("text <> ''").select("doc_id", "page_num", "section", "text", "bbox", "section_title")


def windows(text: Column, most: int = DEFAULTS.max_tokens_per_chunk, overlap: int = DEFAULTS.chunk_overlap_tokens) -> Column:
    """Windows of ``most`` words, ``overlap`` of them shared; a text that fits stays as it is."""
    step = max(1, most - overlap)
    w = words(text)
    count = F.ceil((F.size(w) - most) / step).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count), lambda i: F.array_join(F.slice(w, i * step + 1, most), " "))
    return F.when(F.size(w) <= most, F.array(text)).otherwise(cut)


def chunk(blocks: DataFrame, ocr_pages: DataFrame | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """doc_id, ordinal, page, text, token_count, bbox, section_title, source of each chunk. ``ocr_pages`` (doc_id, page_num) came from a scan."""
    cut = sections(blocks, settings).withColumn("parts", windows(F.col("text"), settings.max_tokens_per_chunk, settings.chunk_overlap_tokens))
    rows = cut.select("doc_id", "page_num", "section", "bbox", "section_title", F.posexplode("parts").alias("part", "text")).where(strip(F.col("text")) != "")
    if ocr_pages is not None:
        rows = rows.join(ocr_pages.select("doc_id", "page_num", F.lit("ocr").alias("source")).distinct(), ["doc_id", "page_num"], "left").withColumn("source", F.coalesce("source", F.lit("pdf_text")))
    else:
        rows = rows.withColumn("source", F.lit("pdf_text"))
    rows = rows.withColumn("stretch", F.floor(F.col("page_num") / PAGES))
    starts = rows.groupBy("doc_id", "stretch").agg(F.count("*").alias("k"))
    starts = starts.select("doc_id", "stretch", (F.sum("k").over(Window.partitionBy("doc_id").orderBy("stretch")) - F.col("k")).alias("start"))
    place = F.row_number().over(Window.partitionBy("doc_id", "stretch").orderBy("page_num", "section", "part")) - 1
    rows = rows.withColumn("place", place).join(starts, ["doc_id", "stretch"])
    return rows.select("doc_id", (F.col("start") + F.col("place")).cast("int").alias("ordinal"), F.col("page_num").alias("page"), "text", F.size(words(F.col("text"))).alias("token_count"), "bbox", "section_title", "source")
