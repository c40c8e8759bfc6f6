from lodestrata.plans import catalog
from lodestrata.session import table

SMALL = "/root/testdata/sf0.001"


def test_ingest_takes_every_document(spark):
    got = catalog.ingest(spark, SMALL).collect()
    assert sum(r.n for r in got) == table(spark, SMALL, "documents").count()
    binder = table(spark, SMALL, "chunks").where("doc_id = 1 and text is not null").count()
    assert binder > 0 and sum(r.chunks for r in got) >= table(spark, SMALL, "chunks").dropDuplicates(["doc_id", "ordinal"]).select("doc_id").distinct().count()


def test_probes_need_no_title(spark):
    d = "/root/testdata/sf0.01"
    rows = catalog._live(spark, d).where("embedding_row % 100 = 0").join(table(spark, d, "chunk_vectors"), "embedding_row")
    assert {r.query_id for r in catalog._probes(spark, d).collect()} == {r.embedding_row for r in rows.select("embedding_row").collect()}
    assert rows.where("section_title is null").count() > 0


def test_every_hash_is_offered(spark):
    d = "/root/testdata/sf0.01"
    rows = table(spark, d, "documents").where("sha256 is not null").collect()
    known = {r.sha256.lower() for r in rows if r.status == "ready" and r.is_deleted == 0}
    got = {r.sha256: r.n for r in catalog.dedup_sha256(spark, d).collect()}
    assert got.keys() - {None} == {r.sha256.lower() for r in rows} - known
    assert got[None] == table(spark, d, "documents").where("sha256 is null").count()
