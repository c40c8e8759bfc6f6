import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestrata.config import Settings
from lodestrata.operators import chunking, corpus
from lodestrata.operators.provider import FakeProvider, embed
from lodestrata.schemas import BLOCKS
from lodestrata.sources import snapshot, uploads
from lodestrata.streaming import ingest as stream

BOX = (0.0, 0.0, 10.0, 10.0)


def blocks(spark, *pages):
    rows = [(1, p, i, t, (0.0, i * 10.0, 100.0, i * 10.0 + 10), s) for p, lines in enumerate(pages, 1) for i, (t, s) in enumerate(lines)]
    return spark.createDataFrame(rows, BLOCKS)


def test_sections_carry_titles_across_pages(spark):
    b = blocks(spark, [("intro", 10.0), ("TITLE", 20.0), ("body one", 10.0), ("more text here", 10.0)], [("next page", 10.0), ("again text", 10.0)])
    out = [(r.page_num, r.text, r.section_title) for r in chunking.sections(b).orderBy("page_num", "section").collect()]
    assert out == [(1, "intro", None), (1, "TITLE body one more text here", "TITLE"), (2, "next page again text", "TITLE")]
    first = chunking.sections(b).where("section = 1 and page_num = 1").first()
    assert tuple(first.bbox) == (0.0, 10.0, 100.0, 40.0)


def test_body_size_ties_and_default(spark):
    assert chunking.body_size(blocks(spark, [("abc", 12.0), ("abc", 9.0)])).first().body == 12.0
    assert chunking.body_size(blocks(spark, [("abc", 0.0)])).first().body == 11.0
    assert chunking.body_size(blocks(spark, [("abc", 10.5)])).first().body == 10.0


@pytest.mark.parametrize(("n", "most", "overlap"), [(0, 4, 1), (4, 4, 1), (5, 4, 1), (9, 4, 1), (6, 3, 5), (5, 1, 0), (7, 4, 4)])
def test_windows_against_loop(spark, n, most, overlap):
    words = [f"w{i}" for i in range(n)]
    text = "  ".join(words)
    wanted, at, step = [], 0, max(1, most - overlap)
    if n <= most:
        wanted = [text]
    else:
        while True:
            wanted.append(" ".join(words[at : at + most]))
            if at + most >= n:
                break
            at += step
    assert spark.createDataFrame([(text,)], "t string").select(chunking.windows(F.col("t"), most, overlap)).first()[0] == wanted


def test_chunk_sources_and_ordinals(spark):
    b = blocks(spark, [("a b c d e", 10.0)], [("  ", 10.0)], [("scan", 10.0)])
    ocr = spark.createDataFrame([(1, 3)], "doc_id bigint, page_num int")
    out = [(r.ordinal, r.page, r.text, r.source) for r in chunking.chunk(b, ocr, Settings(max_tokens_per_chunk=3, chunk_overlap_tokens=1)).orderBy("ordinal").collect()]
    assert out == [(0, 1, "a b c", "pdf_text"), (1, 1, "c d e", "pdf_text"), (2, 3, "scan", "ocr")]


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id bigint, sha256 string, status string, is_deleted int, deleted_at timestamp, ingested_at timestamp")


def test_fresh_uploads(spark):
    have = docs(spark, (1, "AA", "ready", 0, None, None), (2, "bb", "failed", 0, None, None), (3, "cc", "ready", 1, None, None), (4, None, "ready", 0, None, None))
    new = spark.createDataFrame([(10, "aa"), (11, "BB"), (12, "cc"), (13, "dd"), (14, "DD")], "doc_id bigint, sha256 string")
    assert {r.sha256 for r in corpus.fresh(new, have).collect()} == {"bb", "cc", "dd"}


def test_soft_delete(spark):
    have = docs(spark, (1, "a", "ready", 0, None, None), (2, "b", "ready", 1, dt.datetime(2025, 1, 1), None))
    changed, missing = corpus.soft_delete(have, spark.createDataFrame([(1,), (2,), (9,)], "doc_id bigint"))
    assert {r.doc_id: r.is_deleted for r in changed.collect()} == {1: 1, 2: 1}
    assert changed.where("doc_id = 1").first().deleted_at is not None and changed.where("doc_id = 2").first().deleted_at == dt.datetime(2025, 1, 1)
    assert {r.doc_id for r in missing.collect()} == {2, 9}


def test_recovery(spark):
    have = docs(spark, (1, "a", "ready", 0, None, None), (2, "b", "processing", 0, None, None), (3, "c", "ready", 0, None, None))
    chunks = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (3, None)], "doc_id bigint, embedding_row bigint")
    vecs = spark.createDataFrame([(0,), (1,), (7,)], "embedding_row bigint")
    d, v = corpus.recover(have, chunks, vecs)
    assert {r.doc_id: r.status for r in d.collect()} == {1: "ready", 2: "failed", 3: "failed"}
    assert {r.embedding_row for r in v.collect()} == {0}


def test_assign_rows(spark):
    c = spark.createDataFrame([(5, 1), (5, 0), (2, 0)], "doc_id bigint, ordinal int")
    assert {(r.doc_id, r.ordinal): r.embedding_row for r in corpus.assign_rows(c, 9).collect()} == {(2, 0): 10, (5, 0): 11, (5, 1): 12}


def test_uploads(spark):
    rows = [("a.pdf", "application/pdf", b"%PDF-1.7 x"), (None, None, b"%PDF-"), ("b.txt", "text/plain", b"%PDF-"), ("c.pdf", "", b"hello"), ("d.pdf", "", b"%PDF-" + b"x" * 20), ("e", None, None)]
    out = uploads.validate(spark.createDataFrame(rows, "filename string, content_type string, content binary"), Settings(max_pdf_bytes=15)).collect()
    assert [r.error and r.error.split(" ")[0] for r in out] == [None, None, "file", "not", "file", "not"]
    assert out[1].filename == "unnamed.pdf" and [r.candidate for r in out] == [True, True, False, False, True, False]
    none = spark.createDataFrame([("failed", False)], "status string, candidate boolean")
    assert uploads.outcome(none).first().http == 400 and uploads.outcome(none.where("false")).first().http == 200


def test_ocr(spark):
    pages = spark.createDataFrame([(1, 1, "A" * 100), (1, 2, " "), (2, 1, None), (2, 2, "x"), (3, 1, "B" * 60)], "doc_id bigint, page_num int, raw_text string")
    assert {r.doc_id: r.plan for r in uploads.ocr_plan(pages).collect()} == {1: "per_page", 2: "whole", 3: "none"}
    whole = spark.createDataFrame([(1, 2, "a\fb"), (2, 2, "a"), (3, 1, "a\fb")], "doc_id bigint, pages bigint, ocr_text string")
    out = [(r.doc_id, r.page_num, r.ocr_text, r.fits) for r in uploads.split_recognised(whole).orderBy("doc_id", "page_num").collect()]
    assert out == [(1, 1, "a", True), (1, 2, "b", True), (2, 1, "a", False), (3, 1, "a\fb", True)]
    b = blocks(spark, [("x", 10.0)], [("y", 10.0)])
    new = uploads.replace_pages(b, spark.createDataFrame([(1, 1, "scan"), (1, 2, " ")], "doc_id bigint, page_num int, ocr_text string"))
    assert {(r.page_num, r.text) for r in new.collect()} == {(1, "scan"), (2, "y")}


def test_snapshot(spark, tmp_path):
    root = f"file://{tmp_path}/snap"
    assert snapshot.load(spark, root) == ({}, {})
    snapshot.publish(spark, root, {"t": spark.range(3)}, {"embedding_dim": 8})
    snapshot.publish(spark, root, {"t": spark.range(5)}, {"embedding_dim": 8})
    tables, meta = snapshot.load(spark, root, 8)
    assert tables["t"].count() == 5 and meta["embedding_dim"] == 8
    with pytest.raises(ValueError):
        snapshot.load(spark, root, 9)


def test_embed(spark):
    out = embed(spark.createDataFrame([("a",), ("a",), ("",), (None,)], "t string"), "t", FakeProvider(8)).collect()
    assert out[0].embedding == out[1].embedding and sum(x * x for x in out[0].embedding) == pytest.approx(1, abs=1e-5)
    assert set(out[2].embedding) == set(out[3].embedding) == {0.0}


def test_streaming(spark, tmp_path):
    rows = [(1, "AA", dt.datetime(2025, 1, 1)), (2, "aa", dt.datetime(2025, 1, 2)), (3, "bb", dt.datetime(2025, 1, 2)), (4, None, dt.datetime(2025, 1, 2))]
    df = spark.createDataFrame(rows, "doc_id bigint, sha256 string, ingested_at timestamp")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    got = []
    q = stream.run(stream.distinct_uploads(stream.uploads(spark, f"{tmp_path}/in", df.schema)), lambda b, _: got.extend(r.sha256 for r in b.collect()), f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert sorted(got) == ["aa", "bb"]
