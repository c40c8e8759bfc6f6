"""Explicit schemas of the engine's tables. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

BBOX = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x0", "y0", "x1", "y1")])
BLOCKS = T.StructType().add("doc_id", "long").add("page_num", "integer").add("pos", "integer").add("text", "string").add("bbox", BBOX).add("font_size", "double")
DOCUMENTS = (
    T.StructType().add("doc_id", "long").add("filename", "string").add("sha256", "string").add("num_pages", "integer").add("num_chunks", "integer").add("ocr_pages", "integer")
    .add("status", "string").add("is_deleted", "integer").add("deleted_at", "timestamp").add("ingested_at", "timestamp")
)
CHUNKS = (
    T.StructType().add("id", "long").add("doc_id", "long").add("ordinal", "integer").add("page", "integer").add("bbox", BBOX).add("text", "string")
    .add("token_count", "integer").add("section_title", "string").add("embedding_row", "long").add("source", "string")
)

STATUSES = ("processing", "ready", "failed")
SOURCES = ("pdf_text", "ocr")
FORMATS = ("auto", "prose", "list", "table", "json")
INTENTS = ("search", "no_search", "refuse")
