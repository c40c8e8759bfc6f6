import pytest
from pyspark.sql import functions as F

from lodestrata.config import Settings
from lodestrata.operators import index, retrieve
from lodestrata.operators.provider import FakeProvider
from lodestrata.plans import pipeline
from lodestrata.schemas import BLOCKS
from lodestrata.sources import snapshot, uploads
from lodestrata.streaming.ingest import take_in

SETTINGS = Settings(embedding_dim=8, max_pdf_bytes=5000)
LONG = "This page says enough about parental leave and remote work to count as digital."


def parse(files):
    """Pages parted by form feeds; a line that begins with # is set large. A page's file is its number behind the document's."""

    def lines(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for doc, content in zip(batch["doc_id"], batch["content"]):
                for n, page in enumerate(bytes(content)[5:].decode().split("\f"), 1):
                    rows += [(doc, n, k, x.lstrip("#"), {"x0": 0.0, "y0": k * 10.0, "x1": 100.0, "y1": k * 10.0 + 10}, 20.0 if x[0] == "#" else 10.0) for k, x in enumerate(page.split("\n")) if x.strip()]
            yield pd.DataFrame(rows, columns=BLOCKS.fieldNames())

    def pages(batches):
        import pandas as pd

        for batch in batches:
            yield pd.DataFrame([(d, n, p, f"{d}/{n}".encode()) for d, c in zip(batch["doc_id"], batch["content"]) for n, p in enumerate(bytes(c)[5:].decode().split("\f"), 1)], columns=["doc_id", "page_num", "raw_text", "image"])

    some = files.select("doc_id", "content")
    return some.mapInPandas(lines, BLOCKS), some.mapInPandas(pages, "doc_id bigint, page_num int, raw_text string, image binary")


def files(spark, rows):
    return spark.createDataFrame([(d, f"f{d}.pdf", kind, content) for d, kind, content in rows], "doc_id bigint, filename string, content_type string, content binary")


def test_files_come_in_end_to_end(spark, tmp_path):
    root = f"file://{tmp_path}/snapshot"
    mixed, scan, odd, blank = (b"%PDF-" + x for x in (f"#Leave\n{LONG}\f \f{LONG}".encode(), b"\f ", b" \f  \f", b" "))
    provider = FakeProvider(8, (), {b"1/2": "Recognised text of the second page", scan: "whole one\fwhole two", odd: "one text for three pages", b"3/1": "first", b"3/3": "third"})
    first = [(1, "application/pdf", mixed), (2, "", scan), (3, None, odd), (4, "application/pdf", blank), (5, "text/plain", mixed), (6, "", b"no"), (7, "", b"%PDF-" + b"x" * 6000), (8, "", mixed)]
    out = {r.doc_id: (r.status, r.error) for r in pipeline.ingest_files(spark, files(spark, first), root, provider, parse, SETTINGS).collect()}
    assert out == {1: ("ready", None), 2: ("ready", None), 3: ("ready", None), 4: ("failed", "no text"), 5: ("failed", "file is not a pdf"), 6: ("failed", "not a valid PDF"), 7: ("failed", "file exceeds 5000 byte limit"), 8: ("skipped", None)}
    tables, meta = snapshot.load(spark, root, 8)
    chunks = sorted((r.doc_id, r.page, r.source, r.text, r.section_title) for r in tables["chunks"].collect())
    assert [c[:4] for c in chunks] == [
        (1, 1, "pdf_text", f"Leave {LONG}"), (1, 2, "ocr", "Recognised text of the second page"), (1, 3, "pdf_text", LONG), (2, 1, "ocr", "whole one"), (2, 2, "ocr", "whole two"), (3, 1, "ocr", "first"), (3, 3, "ocr", "third"),
    ]
    assert {c[4] for c in chunks if c[0] == 1} == {"Leave"}
    docs = {r.doc_id: (r.status, r.num_pages, r.num_chunks, r.ocr_pages) for r in tables["documents"].collect()}
    assert docs == {1: ("ready", 3, 3, 1), 2: ("ready", 2, 2, 2), 3: ("ready", 3, 2, 2), 4: ("failed", 1, 0, 0)}
    # a second load adds, and finds what was there
    second = [(11, "", mixed), (12, "", b"%PDF-" + LONG.replace("remote", "distant").encode())]
    out = {r.doc_id: r.status for r in pipeline.ingest_files(spark, files(spark, second), root, provider, parse, SETTINGS).collect()}
    assert out == {11: "skipped", 12: "ready"}
    tables, meta = snapshot.load(spark, root, 8)
    rows = sorted(r.embedding_row for r in tables["chunks"].collect())
    assert rows == list(range(8)) == sorted(r.embedding_row for r in tables["vectors"].collect()) and tables["chunks"].select("id").distinct().count() == 8
    asked = spark.createDataFrame([(1, "distant leave"), (2, "whole")], "query_id bigint, query string")
    live = index.token_rows(tables["chunks"])
    want = sorted(map(tuple, retrieve.bm25(live, asked, 5).collect()))
    assert want and sorted(map(tuple, retrieve.bm25_of(pipeline.published_index(tables, meta), asked, 5).collect())) == want
    # what is deleted counts no more
    snapshot.publish(spark, root, {"documents": tables["documents"].withColumn("is_deleted", F.when(F.col("doc_id") == 2, 1).otherwise(F.col("is_deleted")))}, {})
    tables, meta = snapshot.load(spark, root, 8)
    assert retrieve.bm25_of(pipeline.published_index(tables, meta), asked.where("query_id = 2"), 5).count() == 0 and meta["embedding_dim"] == 8
    before = tables["chunks"].count()
    assert len(snapshot.clean(spark, root)) >= 2 and snapshot.load(spark, root)[0]["chunks"].count() == before and snapshot.clean(spark, root) == []


def test_a_folder_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdf").write_bytes(b"%PDF-" + LONG.encode())
    (tmp_path / "in/note.txt").write_bytes(b"no")
    once = uploads.uploads_of(uploads.read_files(spark, f"{tmp_path}/in")).collect()
    assert [(r.filename, bytes(r.content)[:5]) for r in once] == [("a.pdf", b"%PDF-")]
    root, provider = f"file://{tmp_path}/snapshot", FakeProvider(8)
    for n, name in enumerate(("B.PDF", None), 2):
        take_in(spark, f"{tmp_path}/in", root, provider, parse, f"{tmp_path}/progress", SETTINGS).awaitTermination()
        tables, _ = snapshot.load(spark, root, 8)
        assert tables["documents"].count() == tables["chunks"].count() == n - 1
        if name:
            (tmp_path / "in" / name).write_bytes(b"%PDF-" + LONG.upper().encode())


def test_parser_is_needed(spark):
    with pytest.raises(NotImplementedError):
        uploads.parse_pdf(files(spark, []))
