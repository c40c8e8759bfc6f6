"""Answers: citations, the check that they support what is said, the response."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.policy import exempt_sentences, with_disclaimer
from lodestrata.functions.text import citations, looks_factual, sentences, strip, strip_citations


def hydrate(ranked: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """query_id, index, document_id, filename, page, chunk_id, text, score of ranked rows (query_id, row, score, rank).

    Texts are joined after ranking, for what is shown only; a row without chunk leaves its index unused.
    """
    at = chunks.select(F.col("embedding_row").alias("row"), F.col("id").alias("chunk_id"), "doc_id", "page", "text")
    names = documents.select("doc_id", "filename")
    return ranked.join(at, "row").join(names, "doc_id").select("query_id", F.col("rank").alias("index"), F.col("doc_id").alias("document_id"), "filename", "page", "chunk_id", "text", "score")


def claims(answers: DataFrame) -> DataFrame:
    """query_id, sentence_no (from 0), sentence, cited, factual of answers (query_id, answer), without the leading disclaimer's sentences."""
    rows = answers.select("query_id", exempt_sentences(F.col("answer")).alias("skip"), F.posexplode(sentences(F.col("answer"))).alias("sentence_no", "sentence"))
    rows = rows.where("sentence_no >= skip")
    return rows.select("query_id", "sentence_no", "sentence", citations(F.col("sentence")).alias("cited"), looks_factual(F.col("sentence")).alias("factual"))


def pairs(claimed: DataFrame, shown: DataFrame) -> DataFrame:
    """query_id, sentence_no, number, sentence, context of each citation of a shown passage (query_id, index, text) with any text."""
    rows = claimed.select("query_id", "sentence_no", strip_citations(F.col("sentence")).alias("sentence"), F.explode("cited").alias("number"))
    context = shown.where(strip(F.coalesce("text", F.lit(""))) != "").select("query_id", F.col("index").cast("bigint").alias("number"), F.col("text").alias("context"))
    return rows.join(context, ["query_id", "number"])


def verify(answers: DataFrame, claimed: DataFrame, judged: DataFrame) -> DataFrame:
    """query_id, all_supported, unsupported (sentence numbers): a sentence with citations is supported if any of its pairs is (``judged``:
    query_id, sentence_no, supported), one without is if it states nothing; an empty answer as a whole isn't."""
    ok = judged.groupBy("query_id", "sentence_no").agg(F.bool_or("supported").alias("ok"))
    bad = claimed.where("factual or size(cited) > 0").join(ok, ["query_id", "sentence_no"], "left").where(~F.coalesce("ok", F.lit(False)))
    bad = bad.groupBy("query_id").agg(F.sort_array(F.collect_set("sentence_no")).alias("unsupported"))
    out = answers.select("query_id", "answer").join(bad, "query_id", "left").withColumn("unsupported", F.coalesce("unsupported", F.array().cast("array<int>")))
    return out.select("query_id", ((F.size("unsupported") == 0) & (strip(F.coalesce("answer", F.lit(""))) != "")).alias("all_supported"), "unsupported")


def respond(answers: DataFrame) -> DataFrame:
    """Answers (query_id, answer, disclaimer, ...) with the disclaimer put before, refusals too."""
    return answers.withColumn("answer", with_disclaimer(F.coalesce("answer", F.lit("")), F.col("disclaimer")))
