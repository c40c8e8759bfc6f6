"""The two pipelines: documents in, questions answered. Each is one chain of tables for many documents or questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata import schemas
from lodestrata.config import DEFAULTS, Settings
from lodestrata.functions import parsing, prompts
from lodestrata.functions.policy import GREETING, apply_policy
from lodestrata.functions.text import indexed_text, strip
from lodestrata.operators import answer as A
from lodestrata.operators import chunking, corpus, index, rank
from lodestrata.operators.index import token_rows
from lodestrata.operators.provider import Provider, chat, embed
from lodestrata.operators.retrieve import hybrid
from lodestrata.session import Scratch, materialize
from lodestrata.sources import snapshot, uploads


def ingest(blocks: DataFrame, uploads: DataFrame, documents: DataFrame, chunks: DataFrame, provider: Provider, ocr_pages: DataFrame | None = None, settings: Settings = DEFAULTS):
    """(documents, chunks, vectors) that new uploads add: duplicates of active documents are left out, documents without text fail.

    ``blocks`` holds the layout of the uploads (doc_id), ``uploads`` doc_id, filename, sha256, num_pages. Existing tables are only read.
    """
    new = corpus.fresh(uploads, documents)
    cut = chunking.chunk(blocks.join(new.select("doc_id"), "doc_id", "left_semi"), ocr_pages, settings)
    base = chunks.agg(F.coalesce(F.max("embedding_row"), F.lit(-1))).first()[0]
    cut = materialize(corpus.assign_rows(cut, base), "new-chunks")
    counts = cut.groupBy("doc_id").agg(F.count("*").cast("int").alias("num_chunks"), F.countDistinct(F.when(F.col("source") == "ocr", F.col("page"))).cast("int").alias("ocr_pages"))
    docs = new.join(counts, "doc_id", "left").withColumn("status", F.when(F.col("num_chunks").isNull(), "failed").otherwise("ready"))
    docs = docs.withColumn("is_deleted", F.lit(0)).withColumn("ingested_at", F.current_timestamp()).fillna(0, ["num_chunks", "ocr_pages"])
    vectors = embed(cut.withColumn("_t", indexed_text(F.col("section_title"), F.col("text"))), "_t", provider).select("embedding_row", "embedding")
    return docs, cut, vectors


def ingest_files(spark: SparkSession, files: DataFrame, root: str, provider: Provider, parse: Callable[[DataFrame], tuple[DataFrame, DataFrame]] = uploads.parse_pdf, settings: Settings = DEFAULTS) -> DataFrame:
    """Takes uploaded files (doc_id, filename, content_type, content) into the snapshot at ``root``: checked, parsed, recognised where pages have
    too little text, cut, embedded, indexed and published in one step. Returns doc_id, filename, status (ready, skipped, failed), error,
    candidate.

    What is known already is skipped; a file without any text fails. Only new rows are written; readers see all of them or none.
    """
    scratch = Scratch(spark, "ingest")
    tables, _ = snapshot.load(spark, root, settings.embedding_dim)
    checked = uploads.validate(files, settings).withColumn("sha256", corpus.content_hash(F.coalesce("content", F.lit(b""))))
    checked = scratch.keep(checked, "uploads")
    none = spark.createDataFrame([], schemas.DOCUMENTS), spark.createDataFrame([], schemas.CHUNKS)
    documents, chunks = tables.get("documents", none[0]), tables.get("chunks", none[1])
    taken = scratch.keep(corpus.fresh(checked.where("error is null"), documents), "taken")
    blocks, pages = parse(taken)
    pages = scratch.keep(pages, "pages")
    recognised = scratch.keep(uploads.recognised_pages(pages, taken, provider, settings), "texts")
    blocks = uploads.replace_pages(blocks, recognised)
    counts = pages.groupBy("doc_id").agg(F.count("*").cast("int").alias("num_pages"))
    named = taken.select("doc_id", "filename", "sha256").join(counts, "doc_id", "left").fillna(0, ["num_pages"])
    docs, cut, vectors = ingest(blocks, named, documents, chunks, provider, recognised.select("doc_id", "page_num"), settings)
    docs = scratch.keep(docs.withColumn("deleted_at", F.lit(None).cast("timestamp")).select(*schemas.DOCUMENTS.fieldNames()), "new-documents")
    first = chunks.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] - (chunks.agg(F.coalesce(F.max("embedding_row"), F.lit(-1))).first()[0])
    cut = cut.withColumn("id", F.col("embedding_row") + F.lit(first)).select(*schemas.CHUNKS.fieldNames())
    rows = token_rows(cut)
    posts = index.postings(rows).withColumn("bucket", index.bucket_of(F.col("term"), index.BUCKETS))
    added = {"documents": docs, "chunks": cut, "vectors": vectors, "postings": posts, "lengths": rows.select("row", "dl")}
    snapshot.publish(spark, root, {}, {"embedding_dim": settings.embedding_dim, "embedding_model": settings.embedding_model, "tokenizer_version": settings.tokenizer_version}, added, {"postings": "bucket"})
    out = checked.join(docs.select("doc_id", "status"), "doc_id", "left")
    status = F.coalesce("status", F.when(F.col("error").isNull(), F.lit("skipped")).otherwise(F.lit("failed")))
    out = out.select("doc_id", "filename", status.alias("status"), F.when(F.col("status") == "failed", F.lit("no text")).otherwise(F.col("error")).alias("error"), "candidate")
    out = materialize(out, "outcome")
    scratch.close()
    return out


def published_index(tables: dict[str, DataFrame], meta: dict) -> index.Index:
    """The index of a snapshot, of its published rows only: what was deleted counts no more."""
    ready = corpus.ready_rows(tables["chunks"], tables["documents"])
    posts = tables["postings"].join(ready, "row", "left_semi").select("term", "row", "tf", "dl", "bucket")
    return index.Index(posts, index.corpus_stats(tables["lengths"].join(ready, "row", "left_semi")), index.BUCKETS, meta.get("tokenizer_version", "v1"))


def answer(requests: DataFrame, documents: DataFrame, chunks: DataFrame, vectors: DataFrame, provider: Provider, settings: Settings = DEFAULTS) -> DataFrame:
    """One response for each request (query_id, query, top_k, answer_format, document_ids, enable_llm_rerank): query_id, answer, format, intent,
    sub_intent, structured, citations, all_supported, unsupported, disclaimer, entities, refusal_reason, warning.

    Questions leave the chain where they are settled: refused, greetings, documents unknown, no evidence. Replies are written down where later
    stages read them more than once, so that no model is asked twice.
    """
    scratch = Scratch(requests.sparkSession, "answers")
    requests = corpus.once(requests)
    doubtful = apply_policy(requests).where("ask_fallback").select("query_id", prompts.policy_prompt(F.col("disclaimer"), F.col("masked")).alias("prompt"))
    verdicts = scratch.keep(chat(doubtful, "prompt", provider).select("query_id", parsing.policy_reply(F.col("reply")).alias("verdict")), "verdicts")
    asked = apply_policy(requests.join(verdicts, "query_id", "left"), verdict="verdict")
    asked = chat(asked.withColumn("prompt", F.when(F.col("refuse_reason").isNull(), prompts.transform_prompt(F.col("masked")))), "prompt", provider)
    asked = asked.withColumn("t", parsing.transform_reply(F.col("reply"), F.col("masked"))).drop("reply", "prompt")
    checked = corpus.document_filter(requests, documents).select("query_id", "outcome")
    asked = asked.join(checked, "query_id", "left")
    reason = F.coalesce("refuse_reason", F.when(F.col("t.intent") == "refuse", F.lit("personalized_advice")), F.when(F.col("outcome") == "no_valid_documents", F.lit("no_valid_documents")))
    asked = scratch.keep(
        asked.select(
            "query_id", F.col("masked").alias("question"), "t", "disclaimer", "entities", reason.alias("reason"), F.coalesce("top_k", F.lit(5)).alias("top_k"), F.coalesce("enable_llm_rerank", F.lit(True)).alias("reranked"),
            parsing.output_format(F.col("answer_format"), F.col("t.sub_intent")).alias("format"), F.when(F.col("outcome") == "some_missing", F.lit("some documents are unknown")).alias("warning"), F.col("document_ids").isNotNull().alias("masked_rows"),
        ),
        "asked",
    )
    search = asked.where("reason is null and t.intent = 'search'")
    texts = F.concat(F.array("t.rewritten_query"), F.col("t.expansion_queries"))
    parts = embed(search.select("query_id", F.col("masked_rows").alias("limited"), F.posexplode(texts).alias("part", "query")), "query", provider, "vector")
    live = corpus.published(chunks, documents)
    rows, matrix = token_rows(live), vectors.withColumnRenamed("embedding_row", "row").join(live.select(F.col("embedding_row").alias("row")), "row", "left_semi")
    limits = scratch.keep(corpus.allowed_rows(requests, chunks, documents), "limits")
    parts = scratch.keep(parts, "parts")
    found = scratch.keep(hybrid(rows, matrix, parts, settings=settings, within=limits), "found")
    w = Window.partitionBy("query_id").orderBy("rank")
    body = live.select(F.col("embedding_row").alias("row"), "text")

    def reranked(found: DataFrame) -> DataFrame:
        window = rank.window_of(found, settings)
        listed = window.join(body, "row").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("texts"))
        scored = chat(listed.join(search.where("reranked"), "query_id").withColumn("prompt", prompts.rerank_prompt(F.col("t.rewritten_query"), F.col("texts"))), "prompt", provider)
        return scratch.keep(rank.rerank(window, scored.select("query_id", parsing.rerank_reply(F.col("reply")).alias("scores"))), "ranked")

    first = reranked(found)
    # weak evidence: once more, with the vector of a hypothetical answer
    weak = search.where("reranked").join(rank.evidence(first, settings).where("weak"), "query_id", "left_semi")
    guessed = chat(weak.select("query_id", prompts.hyde_prompt(F.col("t.rewritten_query")).alias("prompt")), "prompt", provider)
    guessed = scratch.keep(guessed.select("query_id", strip(F.col("reply")).alias("reply")).where("reply <> ''"), "guessed")
    extra = scratch.keep(embed(guessed, "reply", provider, "vector"), "guessed-vectors")
    again = hybrid(rows, matrix, parts.join(guessed, "query_id", "left_semi"), extra=extra, settings=settings, within=limits)
    second = reranked(scratch.keep(again, "found-again"))
    ranked = first.join(guessed, "query_id", "left_anti").unionByName(second)
    gates = rank.evidence(ranked, settings)
    good = ranked.join(gates.where("passed"), "query_id", "left_semi").where("score > 0")
    good = good.withColumn("rank", F.row_number().over(w))
    shown = scratch.keep(A.hydrate(rank.diversify(good, matrix, search.select("query_id", "top_k"), settings), live, documents), "shown")
    contexts = shown.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("index", "document_id", "filename", "page", "chunk_id", "text", "score"))).alias("citations"))
    generated = chat(
        search.join(contexts, "query_id").withColumn("prompt", prompts.answer_prompt(F.col("question"), F.transform("citations", lambda c: c["text"]), F.col("format"), F.col("disclaimer"))), "prompt", provider
    )
    generated = generated.withColumn("shaped", parsing.structured_reply(F.col("reply"), F.col("format")))
    generated = A.respond(generated.withColumn("answer", F.col("shaped.answer")))
    generated = scratch.keep(generated.select("query_id", "answer", "citations", F.col("shaped.structured").alias("structured")), "generated")
    claimed = A.claims(generated)
    asked_pairs = A.pairs(claimed, shown)
    lists = asked_pairs.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("sentence_no", "number", "sentence", "context"))).alias("p"))
    lists = chat(lists.withColumn("prompt", prompts.entailment_prompt(F.transform("p", lambda x: x["sentence"]), F.transform("p", lambda x: x["context"]))), "prompt", provider)
    lists = lists.withColumn("m", F.coalesce(parsing.entailment_reply(F.col("reply")), F.create_map().cast("map<string,boolean>")))
    judged = lists.select("query_id", "m", F.posexplode("p").alias("i", "x")).select("query_id", "x.sentence_no", F.coalesce(F.try_element_at("m", F.col("i").cast("string")), F.lit(False)).alias("supported"))
    verified = A.verify(generated, claimed, judged)
    out = asked.join(generated.withColumnRenamed("answer", "given"), "query_id", "left").join(verified, "query_id", "left")
    why = F.coalesce("reason", F.when((F.col("t.intent") == "search") & F.col("given").isNull(), F.lit("insufficient_evidence")))
    plain = F.when(why.isNotNull(), F.lit("")).when(F.col("t.intent") == "no_search", F.lit(GREETING)).otherwise(F.col("given"))
    out = A.respond(out.withColumn("refusal_reason", why).withColumn("answer", plain))
    out = materialize(out.select("query_id", "answer", "format", "t.intent", "t.sub_intent", "structured", "citations", "all_supported", "unsupported", "disclaimer", "entities", "refusal_reason", "warning"), "answers")
    scratch.close()
    return out
