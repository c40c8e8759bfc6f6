"""The catalogue of queries over the engine's operators, and the same queries in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestrata.config import Settings
from lodestrata.functions import masks, parsing, policy, text, vectors
from lodestrata.operators import answer, chunking, corpus, index, rank, retrieve
from lodestrata.operators.provider import FakeProvider
from lodestrata.plans import pipeline
from lodestrata.plans.oracle import ORACLE
from lodestrata.session import shared_dir, table
from lodestrata.sources import uploads

SMALL_WINDOWS = Settings(max_tokens_per_chunk=64, chunk_overlap_tokens=16)


def _live(spark, d):
    return corpus.published(table(spark, d, "chunks"), table(spark, d, "documents"))


def _rows(spark, d):
    return index.token_rows(_live(spark, d))


def _questions(spark, d):
    """The stated query set of text searches: every request whose id is divisible by 100, against all rows."""
    return corpus.once(table(spark, d, "requests")).where("query_id % 100 = 0").select("query_id", "query")


def _matrix(spark, d):
    live = _live(spark, d).select("embedding_row")
    return table(spark, d, "chunk_vectors").join(live, "embedding_row", "left_semi").select(F.col("embedding_row").alias("row"), "embedding")


def _probes(spark, d):
    """The stated query set of vector searches: every row divisible by 100, its section title, else its text, as text, its vector as vector."""
    titled = _live(spark, d).where("embedding_row % 100 = 0").select(F.col("embedding_row").alias("query_id"), F.coalesce("section_title", "text").alias("query"))
    own = table(spark, d, "chunk_vectors").select(F.col("embedding_row").alias("query_id"), F.col("embedding").alias("vector"))
    return titled.join(own, "query_id")


def _english(spark, d):
    docs = table(spark, d, "documents").where("lang = 'en'").select("doc_id")
    return _live(spark, d).join(docs, "doc_id", "left_semi").select(F.col("embedding_row").alias("row"))


def _rounded(df, digits=6):
    return df.withColumn("score", F.round("score", digits)).withColumn("rank", F.col("rank").cast("bigint"))


def tokenize_counts(spark, d):
    posts = index.postings(_rows(spark, d))
    return posts.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


def corpus_stats(spark, d):
    return index.corpus_stats(_rows(spark, d)).select("n", F.round("avgdl", 6).alias("avgdl"))


def term_idf(spark, d):
    rows = _rows(spark, d)
    df = index.term_df(index.postings(rows))
    return df.crossJoin(F.broadcast(index.corpus_stats(rows).select("n"))).select("term", "df", F.round(index.idf(F.col("n"), F.col("df")), 6).alias("idf"))


def bm25_topk(spark, d):
    return _rounded(retrieve.bm25(_rows(spark, d), _questions(spark, d), 10))


def bm25_saved(spark, d):
    """The same questions, from an index that is saved and opened again."""
    saved = index.save(_rows(spark, d), f"{shared_dir(spark)}/bm25-{uuid.uuid4().hex}")
    return _rounded(retrieve.bm25_of(saved, _questions(spark, d), 10))


def all_questions(spark, d):
    """BM25 of every question in the log. For the smallest tables; larger ones take the stated query set."""
    return _rounded(retrieve.bm25(_rows(spark, d), corpus.once(table(spark, d, "requests")).select("query_id", "query"), 10))


def bm25_topk_masked(spark, d):
    return _rounded(retrieve.bm25(_rows(spark, d), _questions(spark, d), 10, _english(spark, d)))


def dense_topk(spark, d):
    return _rounded(retrieve.dense(_matrix(spark, d), _probes(spark, d), 10), 5)


def dense_topk_masked(spark, d):
    return _rounded(retrieve.dense(_matrix(spark, d), _probes(spark, d), 10, _english(spark, d)), 5)


def hybrid_search(spark, d):
    probes = _probes(spark, d).withColumn("part", F.lit(0))
    return _rounded(retrieve.hybrid(_rows(spark, d), _matrix(spark, d), probes).where("rank <= 10"))


def multi_query_hybrid(spark, d):
    """Each probe with one expansion: its site's name as text, and the same vector."""
    probes = _probes(spark, d)
    sites = _live(spark, d).select(F.col("embedding_row").alias("query_id"), "doc_id").join(table(spark, d, "documents").select("doc_id", F.col("source").alias("site")), "doc_id")
    more = probes.select("query_id", "vector").join(sites.where("site is not null"), "query_id").select("query_id", F.col("site").alias("query"), "vector", F.lit(1).alias("part"))
    return _rounded(retrieve.hybrid(_rows(spark, d), _matrix(spark, d), probes.withColumn("part", F.lit(0)).unionByName(more)).where("rank <= 10"))


def _cited(spark, d):
    """Citations as candidates: each request's cited chunks with a row, in order, once each."""
    cites = table(spark, d, "citations").select("query_id", "cite_no", "chunk_id", "score").distinct()
    rows = table(spark, d, "chunks").where("embedding_row is not null").select(F.col("id").alias("chunk_id"), F.col("embedding_row").alias("row"))
    best = cites.join(rows, "chunk_id").groupBy("query_id", "row").agg(F.min("cite_no").alias("cite_no"), F.max(F.coalesce("score", F.lit(0.0))).alias("score"))
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy("cite_no", "row")
    return best.withColumn("rank", F.row_number().over(w))


def rerank_merge(spark, d):
    """Replies of five shapes: none, one with scores out of range and unreadable entries, one with a repeated id, an empty list, no JSON."""
    cands = _cited(spark, d)
    entry = lambda i, score: F.struct(F.lit(i).alias("id"), F.lit(score).alias("score"))
    full = F.array(entry("0", "1.7"), entry("1", "0.25"), entry("x", "0.9"), entry("2", "high"))
    twice = F.array(entry("1", "-3"), entry("0", "0.5"), entry("1", "0.75"), entry("99", "1"))
    shape = F.pmod("query_id", F.lit(5))
    reply = F.when(shape == 1, F.to_json(F.struct(full.alias("scores")))).when(shape == 2, F.to_json(F.struct(twice.alias("scores")))).when(shape == 3, F.lit('{"scores":[]}')).when(shape == 4, F.lit("no scores"))
    scores = cands.select("query_id").distinct().select("query_id", parsing.rerank_reply(reply).alias("scores"))
    return _rounded(rank.rerank(cands.select("query_id", "row", "score", "rank"), scores))


def _by_score(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "cite_no", "row")
    return _cited(spark, d).withColumn("rank", F.row_number().over(w)).select("query_id", "row", "score", "rank")


def evidence_gate(spark, d):
    out = rank.evidence(_by_score(spark, d))
    return out.select("query_id", "passed", F.round("top", 6).alias("top"), "weak", F.col("kept").cast("bigint").alias("kept"))


def mmr_select(spark, d):
    cands = retrieve.dense(_matrix(spark, d), _probes(spark, d), 40)
    return _rounded(rank.diversify(cands, _matrix(spark, d), 5), 5)


def citations_hydrate(spark, d):
    out = answer.hydrate(_by_score(spark, d), table(spark, d, "chunks").where("embedding_row is not null"), table(spark, d, "documents"))
    return out.select("query_id", F.col("index").cast("bigint").alias("cite_index"), "document_id", "filename", "page", "chunk_id", "text", F.round("score", 6).alias("score"))


def verify_support(spark, d):
    """Answers made of one cited sentence for each citation, a sentence counting as supported at a score of at least a half."""
    by = _by_score(spark, d)
    item = F.concat(F.lit("Entry "), F.col("rank").cast("string"), F.lit(" holds. ["), F.col("rank").cast("string"), F.lit("]"))
    answers = by.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", item.alias("s")))), lambda x: F.regexp_replace(x["s"], r" holds\. (\[\d+\])$", " holds $1.")), " ").alias("answer"))
    shown = answer.hydrate(by, table(spark, d, "chunks").where("embedding_row is not null"), table(spark, d, "documents"))
    claimed = answer.claims(answers)
    judged = answer.pairs(claimed, shown).join(shown.select("query_id", F.col("index").cast("bigint").alias("number"), "score"), ["query_id", "number"]).select("query_id", "sentence_no", (F.col("score") >= 0.5).alias("supported"))
    out = answer.verify(answers, claimed, judged)
    return out.select("query_id", "all_supported", F.array_join(F.transform("unsupported", lambda x: x.cast("string")), ",").alias("unsupported"))


def citation_parse(spark, d):
    """Sentences of five shapes made from the citations: with several numbers, a question, without letters, without citations, with blanks of
    other kinds and brackets that cite nothing."""
    cites = table(spark, d, "citations").select("query_id", "cite_no", "chunk_id").distinct()
    cite, chunk, query = (F.col(c).cast("string") for c in ("cite_no", "chunk_id", "query_id"))
    shape = F.pmod(F.col("query_id") + F.col("cite_no"), F.lit(5))
    sentence = (
        F.when(shape == 0, F.concat(F.lit("Stated ["), cite, F.lit("] and ["), chunk, F.lit(" , "), query, F.lit("] but not [x1].")))
        .when(shape == 1, F.concat(F.lit("Is it so ["), cite, F.lit("]?")))
        .when(shape == 2, F.concat(cite, F.lit(" % ["), chunk, F.lit("]")))
        .when(shape == 3, F.concat(F.lit("Plain claim "), chunk, F.lit(".")))
        .otherwise(F.concat(F.lit("  A\u00a0 [ "), cite, F.lit("] \t["), chunk, F.lit("][], [1,] end ["), cite, F.lit(","), cite, F.lit("]")))
    )
    made = cites.select("query_id", "cite_no", "chunk_id", sentence.alias("sentence"))
    return made.select("query_id", "cite_no", "chunk_id", F.array_join(F.transform(text.citations(F.col("sentence")), lambda x: x.cast("string")), ",").alias("cited"), text.strip_citations(F.col("sentence")).alias("bare"), text.looks_factual(F.col("sentence")).alias("factual"))


def split_sentences(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("sentence_no", "sentence"))


def chunk_windows(spark, d):
    s = SMALL_WINDOWS
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(chunking.windows(F.col("text"), s.max_tokens_per_chunk, s.chunk_overlap_tokens)).alias("part", "piece"))
    return rows.select("doc_id", F.col("part").cast("bigint").alias("part"), text.approx_tokens(F.col("piece")).cast("bigint").alias("n_tokens"), "piece")


def _blocks(spark, d):
    """Lines of chunks as blocks of a page: font size by how much of a line is upper case, boxes from the line's place."""
    lines = table(spark, d, "chunks").dropDuplicates(["doc_id", "ordinal"]).select("doc_id", "page", "ordinal", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    pos = F.col("ordinal") * 1000 + F.col("line")
    size = F.when((F.upper("text") == F.col("text")) & F.col("text").rlike("[A-Z]"), 14.5).otherwise(10.0 + F.length("text") % 3)
    box = F.struct((pos % 7).cast("double").alias("x0"), (F.col("line") * 10).cast("double").alias("y0"), (100 + F.length("text")).cast("double").alias("x1"), (F.col("line") * 10 + 10).cast("double").alias("y1"))
    return lines.select("doc_id", F.col("page").alias("page_num"), pos.alias("pos"), "text", box.alias("bbox"), size.cast("double").alias("font_size"))


def body_size_mode(spark, d):
    return chunking.body_size(_blocks(spark, d)).select("doc_id", "page_num", F.col("body").cast("double").alias("body"))


def heading_sections(spark, d):
    out = chunking.sections(_blocks(spark, d))
    return out.select("doc_id", "page_num", F.col("section").cast("bigint").alias("section"), F.md5("text").alias("text_md5"), "bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1", "section_title")


def layout_chunks(spark, d):
    scans = table(spark, d, "chunks").where("source = 'ocr'").select("doc_id", F.col("page").alias("page_num")).distinct()
    out = chunking.chunk(_blocks(spark, d), scans, SMALL_WINDOWS)
    return out.select("doc_id", "ordinal", "page", "text", "token_count", "bbox.x0", "bbox.y1", "section_title", "source")


def indexed_text(spark, d):
    return table(spark, d, "chunks").select("id", F.md5(text.indexed_text(F.col("section_title"), F.col("text"))).alias("text_md5"))


def pii_email_ssn(spark, d):
    q = table(spark, d, "requests").select("query_id", "logged_at", F.regexp_replace(F.regexp_replace("query", masks.EMAIL, "[EMAIL]"), masks.SSN, "[SSN]").alias("masked"))
    return q.select("query_id", "masked").distinct()


def pii_full(spark, d):
    rows = table(spark, d, "chunks").select("id", "text").where("text is not null")
    return masks.with_masked(rows, "text").select("id", "masked", F.array_join("entities", ",").alias("entities"))


def topic_policy(spark, d):
    q = corpus.once(table(spark, d, "requests")).select("query_id", F.coalesce("query", F.lit("")).alias("query"))
    return q.select("query_id", policy.topic(F.col("query")).alias("topic"), policy.asks_for_advice(F.col("query")).alias("personal"), policy.is_ambiguous(F.col("query")).alias("ambiguous"))


def policy_routing(spark, d):
    out = policy.apply_policy(corpus.once(table(spark, d, "requests")))
    return out.select("query_id", "masked", F.array_join("entities", ",").alias("entities"), "disclaimer", "refuse_reason", "ask_fallback")


def transform_parse(spark, d):
    """Replies made from the requests: every third one unreadable, intents in turn, a blank rewrite for odd ones."""
    q = corpus.once(table(spark, d, "requests")).select("query_id", F.coalesce("query", F.lit("")).alias("query"))
    intent = F.when(F.col("query_id") % 5 == 0, "NO_SEARCH").when(F.col("query_id") % 5 == 1, "REFUSE").when(F.col("query_id") % 5 == 2, "OTHER").otherwise("SEARCH")
    made = F.to_json(F.struct(intent.alias("intent"), F.when(F.col("query_id") % 2 == 0, "list").otherwise("null").alias("sub_intent"), F.when(F.col("query_id") % 2 == 0, F.lit(" rewritten ")).otherwise("").alias("rewritten_query"), F.array(F.lit(" a "), F.lit(""), F.lit("b"), F.lit("c"), F.lit("d")).alias("expansion_queries")))
    t = parsing.transform_reply(F.when(F.col("query_id") % 3 == 0, F.lit("not json")).otherwise(made), F.col("query"))
    out = q.select("query_id", t.alias("t"))
    return out.select("query_id", "t.intent", "t.sub_intent", "t.rewritten_query", F.array_join("t.expansion_queries", "|").alias("expansions"), parsing.output_format(F.lit(None).cast("string"), F.col("t.sub_intent")).alias("format"))


def disclaimers(spark, d):
    q = corpus.once(table(spark, d, "requests")).select("query_id", F.coalesce("query", F.lit("")).alias("query"))
    return q.select("query_id", policy.with_disclaimer(F.col("query"), policy.topic(F.col("query"))).alias("answer"))


def request_validation(spark, d):
    return corpus.validate_requests(corpus.once(table(spark, d, "requests")))


def request_dedup(spark, d):
    return corpus.once(table(spark, d, "requests")).select("query_id", "query", "top_k", "answer_format", "enable_llm_rerank", "logged_at")


def document_filter(spark, d):
    return corpus.document_filter(corpus.once(table(spark, d, "requests")), table(spark, d, "documents"))


def masked_rows(spark, d):
    out = corpus.allowed_rows(corpus.once(table(spark, d, "requests")), table(spark, d, "chunks"), table(spark, d, "documents"))
    return out.groupBy("query_id").agg(F.count("*").alias("n_rows"), F.min("row").alias("first_row"), F.max("row").alias("last_row"))


def ready_rows(spark, d):
    return corpus.ready_rows(table(spark, d, "chunks"), table(spark, d, "documents"))


def last_row(spark, d):
    return corpus.last_row(table(spark, d, "chunks"), table(spark, d, "documents"))


def doc_listing(spark, d):
    return corpus.listing(table(spark, d, "documents"))


def status_counts(spark, d):
    return table(spark, d, "documents").groupBy("status", "is_deleted").agg(F.count("*").alias("n"), F.sum("num_chunks").alias("chunks"), F.sum("ocr_pages").alias("ocr_pages"))


def dedup_sha256(spark, d):
    """Uploads against the active documents: every document arrives again under a new number."""
    docs = table(spark, d, "documents")
    return corpus.fresh(docs.select("doc_id", "sha256"), docs).groupBy("sha256").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def lookups(spark, d):
    """Active documents by hash, of those that some failed or deleted document has, and by id, of those that requests name."""
    docs = table(spark, d, "documents")
    lost = docs.where("status = 'failed' or is_deleted = 1")
    named = table(spark, d, "requests").select(F.explode("document_ids").alias("doc_id"))
    return corpus.by_hash(docs, lost).select(F.lit("hash").alias("by"), "doc_id").unionByName(corpus.by_id(docs, named).select(F.lit("id").alias("by"), "doc_id"))


def released_rows(spark, d):
    """Chunks by whether they have an index row after unfinished documents lost theirs."""
    out = corpus.released(table(spark, d, "chunks"), table(spark, d, "documents"))
    return out.groupBy("doc_id").agg(F.count("*").alias("n"), F.count("embedding_row").alias("n_rows"))


def text_hash(spark, d):
    return table(spark, d, "documents").where("text is not null").groupBy(corpus.content_hash(F.encode("text", "utf-8")).alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def assign_rows(spark, d):
    new = table(spark, d, "chunks").where("embedding_row is null").select("id", "doc_id", "ordinal").dropDuplicates(["doc_id", "ordinal"])
    base = corpus.last_row(table(spark, d, "chunks"), table(spark, d, "documents")).first()[0]
    return corpus.assign_rows(new.select("doc_id", "ordinal"), base)


def mark_unfinished(spark, d):
    return corpus.mark_unfinished(table(spark, d, "documents")).groupBy("status").agg(F.count("*").alias("n"))


def soft_delete(spark, d):
    docs = table(spark, d, "documents")
    changed, missing = corpus.soft_delete(docs, docs.where("doc_id % 7 = 0").select("doc_id"))
    return changed.groupBy("is_deleted").agg(F.count("*").alias("n"), F.count("deleted_at").alias("dated")).withColumn("missing", F.lit(None).cast("bigint")).unionByName(
        missing.agg(F.count("*").alias("missing")).select(F.lit(-1).alias("is_deleted"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("dated"), "missing")
    )


def evicted_rows(spark, d):
    """Index rows that the deletion of every seventh document takes out of searches."""
    docs = table(spark, d, "documents")
    changed, _ = corpus.soft_delete(docs, docs.where("doc_id % 7 = 0").select("doc_id"))
    return corpus.evicted(table(spark, d, "chunks"), docs, changed)


def recovery(spark, d):
    """The corpus after losing every tenth vector."""
    vecs = table(spark, d, "chunk_vectors").where("embedding_row % 10 <> 3")
    docs, kept = corpus.recover(table(spark, d, "documents"), table(spark, d, "chunks"), vecs)
    by = docs.groupBy("status").agg(F.count("*").alias("n"))
    return by.unionByName(kept.agg(F.count("*").alias("n")).select(F.lit("vectors").alias("status"), "n"))


def integrity(spark, d):
    """Of the corpus after losing every tenth vector, and with every eleventh cut short."""
    vecs = table(spark, d, "chunk_vectors").where("embedding_row % 10 <> 3")
    vecs = vecs.withColumn("embedding", F.when(F.col("embedding_row") % 11 == 5, F.slice("embedding", 1, 60)).otherwise(F.col("embedding")))
    return corpus.check(table(spark, d, "documents"), table(spark, d, "chunks"), vecs, 64)


def l2_normalize(spark, d):
    v = table(spark, d, "chunk_vectors").select("embedding_row", vectors.l2_normalize(F.col("embedding")).alias("u"))
    return v.select("embedding_row", F.round(vectors.norm(F.col("u")), 6).alias("length"), F.round(F.col("u")[0], 6).alias("first"))


def upload_validation(spark, d):
    """Documents as uploads: the text with or without a PDF's first bytes, content types in turn."""
    docs = table(spark, d, "documents")
    kind = F.when(F.col("doc_id") % 4 == 0, "application/pdf").when(F.col("doc_id") % 4 == 1, "text/plain").otherwise("")
    head = F.when(F.col("doc_id") % 5 == 0, F.lit("")).otherwise(F.lit("%PDF-1.7 "))
    made = docs.select("doc_id", F.when(F.col("doc_id") % 9 == 0, F.lit(None)).otherwise(F.col("filename")).alias("filename"), kind.alias("content_type"), F.encode(F.concat(head, F.coalesce("text", F.lit(""))), "utf-8").alias("content"))
    out = uploads.validate(made, Settings(max_pdf_bytes=2000))
    return out.select("doc_id", "filename", "error", "candidate")


def ocr_plan(spark, d):
    pages = table(spark, d, "chunks").groupBy("doc_id", F.col("page").alias("page_num")).agg(F.max("text").alias("raw_text"))
    pages = pages.withColumn("raw_text", F.when((F.col("doc_id") + F.col("page_num")) % 3 == 0, F.lit("  short ")).otherwise(F.col("raw_text")))
    return uploads.ocr_plan(pages)


def answers(spark, d):
    """The whole chain for the stated query set, with a fake provider."""
    asked = table(spark, d, "requests").where("query_id % 100 = 0")
    out = pipeline.answer(asked, table(spark, d, "documents"), table(spark, d, "chunks"), table(spark, d, "chunk_vectors"), FakeProvider(64))
    return out.withColumn("citations", F.size("citations")).withColumn("unsupported", F.size("unsupported")).withColumn("entities", F.array_join("entities", ","))


def ingest(spark, d):
    """Documents that arrive again with other bytes: all are taken in anew."""
    docs = table(spark, d, "documents")
    new = docs.select((F.col("doc_id") + 10_000_000_000).alias("doc_id"), "filename", F.sha2(F.col("doc_id").cast("string"), 256).alias("sha256"), "num_pages")
    blocks = _blocks(spark, d).withColumn("doc_id", F.col("doc_id") + 10_000_000_000)
    out, cut, _ = pipeline.ingest(blocks, new, docs, table(spark, d, "chunks"), FakeProvider(8))
    return out.groupBy("status").agg(F.count("*").alias("n"), F.sum("num_chunks").alias("chunks"))


_QUERIES = (
    tokenize_counts, corpus_stats, term_idf, bm25_topk, bm25_topk_masked, bm25_saved, dense_topk, dense_topk_masked, hybrid_search, multi_query_hybrid, rerank_merge, evidence_gate, mmr_select,
    citations_hydrate, verify_support, citation_parse, split_sentences, chunk_windows, body_size_mode, heading_sections, layout_chunks, indexed_text, pii_email_ssn, pii_full, topic_policy,
    policy_routing, transform_parse, disclaimers, request_validation, request_dedup, document_filter, masked_rows, ready_rows, last_row, doc_listing, status_counts, dedup_sha256, text_hash,
    assign_rows, mark_unfinished, released_rows, lookups, soft_delete, evicted_rows, recovery, integrity, l2_normalize, upload_validation, ocr_plan, answers, ingest,
)


def queries() -> dict:
    """Name to callable (spark, sf_dir)."""
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
