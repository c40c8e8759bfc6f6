"""The corpus' life: hashes, duplicates, states, published rows, deletion, recovery. Tables are never changed in place; each operation gives a new one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.schemas import FORMATS, STATUSES

#: Chunks of a document, and documents, that are put in order together.
STRETCH = 4_096


def active(documents: DataFrame) -> DataFrame:
    """Ready and not deleted; both conditions reach the scan."""
    return documents.where((F.col("status") == "ready") & (F.col("is_deleted") == 0))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def published(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks of active documents that have a row in the index."""
    return chunks.where("embedding_row is not null").join(active(documents).select("doc_id"), "doc_id", "left_semi")


def ready_rows(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """row of each published chunk."""
    return published(chunks, documents).select(F.col("embedding_row").alias("row"))


def last_row(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """The greatest published row, -1 without any."""
    return ready_rows(chunks, documents).agg(F.coalesce(F.max("row"), F.lit(-1)).alias("last_row"))


def listing(documents: DataFrame) -> DataFrame:
    """All documents, deleted and failed ones too, newest first."""
    fields = ("doc_id", "filename", "status", "num_pages", "num_chunks", "ocr_pages", "is_deleted", "ingested_at")
    return documents.select(*fields).orderBy(F.desc("ingested_at"), "doc_id")


def document_filter(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """query_id, n_valid, n_missing, outcome of requests that name documents: error where none is active (an empty list too), warning where some aren't."""
    asked = requests.where("document_ids is not null").select("query_id", F.explode_outer(F.array_distinct("document_ids")).alias("doc_id")).distinct()
    known = active(documents).select("doc_id", F.lit(1).alias("ok")).distinct()
    counts = asked.join(known, "doc_id", "left").groupBy("query_id").agg(F.count("ok").alias("n_valid"), F.count(F.when(F.col("doc_id").isNotNull() & F.col("ok").isNull(), 1)).alias("n_missing"))
    outcome = F.when(F.col("n_valid") == 0, "no_valid_documents").when(F.col("n_missing") > 0, "some_missing").otherwise("ok")
    return counts.withColumn("outcome", outcome)


def allowed_rows(requests: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """query_id, row: the rows each request that names documents may see."""
    asked = requests.where("document_ids is not null").select("query_id", F.explode("document_ids").alias("doc_id")).distinct()
    return asked.join(published(chunks, documents).select("doc_id", F.col("embedding_row").alias("row")), "doc_id").select("query_id", "row")


def fresh(uploads: DataFrame, documents: DataFrame) -> DataFrame:
    """Uploads (doc_id, sha256) that no active document has; of equal uploads the one of the smallest doc_id. An unknown hash equals none, and a
    failed or deleted document may be uploaded again."""
    known = active(documents).select(F.lower("sha256").alias("sha256")).where("sha256 is not null").distinct()
    uploads = uploads.withColumn("sha256", F.lower("sha256"))
    first = uploads.where("sha256 is not null").groupBy("sha256").agg(F.min("doc_id").alias("doc_id"))
    hashed = uploads.where("sha256 is not null").dropDuplicates(["sha256", "doc_id"]).join(first, ["sha256", "doc_id"], "left_semi").join(known, "sha256", "left_anti")
    return hashed.unionByName(uploads.where("sha256 is null"))


def assign_rows(new_chunks: DataFrame, base: int) -> DataFrame:
    """``embedding_row`` after ``base`` in order of document and ordinal.

    The numbering is global, but nothing global is put in order in one place: chunks are numbered in stretches of a document, stretches in ranges
    of documents, and of each range one number goes on.
    """
    chunks = new_chunks.withColumn("_s", F.floor(F.col("ordinal") / STRETCH)).withColumn("_r", F.floor(F.col("doc_id") / STRETCH))
    placed = chunks.withColumn("_p", F.row_number().over(Window.partitionBy("doc_id", "_s").orderBy("ordinal")))
    sizes = chunks.groupBy("_r", "doc_id", "_s").agg(F.count("*").alias("k"))
    ranges = sizes.groupBy("_r").agg(F.sum("k").alias("k"))
    ranges = ranges.select("_r", (F.sum("k").over(Window.orderBy("_r")) - F.col("k")).alias("_a"))
    starts = sizes.withColumn("_b", F.sum("k").over(Window.partitionBy("_r").orderBy("doc_id", "_s")) - F.col("k")).join(ranges, "_r").select("doc_id", "_s", (F.col("_a") + F.col("_b")).alias("_b"))
    return placed.join(starts, ["doc_id", "_s"]).withColumn("embedding_row", (F.lit(base) + F.col("_b") + F.col("_p")).cast("bigint")).drop("_s", "_r", "_p", "_b")


def mark_unfinished(documents: DataFrame) -> DataFrame:
    """Documents with processing made failed."""
    return documents.withColumn("status", F.when(F.col("status").isin("processing", "failed"), F.lit("failed")).otherwise(F.col("status")))


def released(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """``chunks`` of which those of unfinished and failed documents have no index row any more."""
    gone = documents.where(F.col("status").isin("processing", "failed")).select("doc_id", F.lit(1).alias("_gone")).distinct()
    return chunks.join(gone, "doc_id", "left").withColumn("embedding_row", F.when(F.col("_gone").isNull(), F.col("embedding_row"))).drop("_gone")


def by_hash(documents: DataFrame, hashes: DataFrame) -> DataFrame:
    """Active documents of the hashes (sha256) asked for."""
    return active(documents).join(hashes.select(F.lower("sha256").alias("_h")).where("_h is not null").distinct(), F.lower("sha256") == F.col("_h"), "left_semi")


def by_id(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """Active documents of the ids (doc_id) asked for."""
    return active(documents).join(ids.select("doc_id").distinct(), "doc_id", "left_semi")


def soft_delete(documents: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with the flag set, ids not found or deleted before)."""
    wanted = ids.select("doc_id").distinct()
    hit = documents.join(wanted.withColumn("gone", F.lit(1)), "doc_id", "left")
    now = F.col("gone").isNotNull() & (F.col("is_deleted") == 0)
    changed = hit.withColumn("deleted_at", F.when(now, F.current_timestamp()).otherwise(F.col("deleted_at").cast("timestamp"))).withColumn("is_deleted", F.when(now, 1).otherwise(F.col("is_deleted"))).drop("gone")
    return changed, wanted.join(documents.where("is_deleted = 0").select("doc_id"), "doc_id", "left_anti")


def evicted(chunks: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """row of each chunk that was published with the documents as they were before and isn't any more."""
    return ready_rows(chunks, before).join(ready_rows(chunks, after), "row", "left_anti")


def recover(documents: DataFrame, chunks: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, vectors) made consistent: unfinished documents failed, documents failed whose rows have no vector, vectors dropped that no
    active document refers to. Rows are keyed, so nothing is cut by position."""
    docs = mark_unfinished(documents)
    lost = published(chunks, docs).join(vectors.select("embedding_row").distinct(), "embedding_row", "left_anti").select("doc_id").distinct()
    docs = docs.join(lost.withColumn("lost", F.lit(1)), "doc_id", "left").withColumn("status", F.when(F.col("lost").isNotNull(), "failed").otherwise(F.col("status"))).drop("lost")
    return docs, vectors.join(ready_rows(chunks, docs).select(F.col("row").alias("embedding_row")), "embedding_row", "left_semi")


def check(documents: DataFrame, chunks: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """violation, n: chunks without document, unknown states, unknown sources, repeated index rows, vectors of another length, published rows
    without a vector."""
    orphans = chunks.join(documents.select("doc_id"), "doc_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("orphan_chunk").alias("violation"), "n")
    states = documents.where(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))).agg(F.count("*").alias("n")).select(F.lit("status").alias("violation"), "n")
    sources = chunks.where(~F.coalesce(F.col("source").isin("pdf_text", "ocr"), F.lit(False))).agg(F.count("*").alias("n")).select(F.lit("source").alias("violation"), "n")
    twice = chunks.where("embedding_row is not null").groupBy("embedding_row").count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("row_twice").alias("violation"), "n")
    length = vectors.where(F.coalesce(F.size("embedding"), F.lit(-1)) != dim).agg(F.count("*").alias("n")).select(F.lit("vector_length").alias("violation"), "n")
    bare = ready_rows(chunks, documents).join(vectors.select(F.col("embedding_row").alias("row")), "row", "left_anti").agg(F.count("*").alias("n")).select(F.lit("no_vector").alias("violation"), "n")
    return orphans.unionByName(states).unionByName(sources).unionByName(twice).unionByName(length).unionByName(bare)


def validate_requests(requests: DataFrame) -> DataFrame:
    """query_id, error: the first rule a request breaks (null: none)."""
    error = (
        F.when(F.col("query").isNull() | ~F.length("query").between(1, 2000), F.lit("query"))
        .when(F.col("top_k").isNotNull() & ~F.col("top_k").between(1, 20), F.lit("top_k"))
        .when(F.col("answer_format").isNotNull() & ~F.col("answer_format").isin(*FORMATS), F.lit("format"))
    )
    return requests.select("query_id", error.alias("error"))


def once(requests: DataFrame) -> DataFrame:
    """Requests without repeated deliveries: the first logged of each query_id."""
    w = Window.partitionBy("query_id").orderBy("logged_at")
    return requests.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
