import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrata.config import Settings
from lodestrata.operators import index, rank, retrieve
from lodestrata.operators.provider import FakeProvider
from lodestrata.plans import catalog, pipeline


def rows_of(spark, texts):
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "embedding_row bigint, text string, section_title string")
    return index.token_rows(df)


def brute(texts, query, allowed=None, k1=1.5, b=0.75):
    docs = [t.lower().split() for t in texts]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    out = {}
    for term in query.lower().split():
        df = sum(term in d for d in docs)
        if not df:
            continue
        w = max(0.01, math.log(1 + (n - df + 0.5) / (df + 0.5)))
        for i, d in enumerate(docs):
            tf = d.count(term)
            if tf and (allowed is None or i in allowed):
                out[i] = out.get(i, 0) + w * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(d) / (avg or 1)))
    return out


def test_bm25_against_brute_force(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choices(["red", "blue", "green", "seal", "valve", "form"], k=rng.randint(0, 12))) for _ in range(40)]
    queries = ["red seal", "red red valve", "form", "unknown word", ""]
    q = spark.createDataFrame(list(enumerate(queries)), "query_id bigint, query string")
    for allowed in (None, {1, 5, 7, 30}):
        mask = None if allowed is None else spark.createDataFrame([(i,) for i in allowed], "row bigint")
        got = {}
        for r in retrieve.bm25(rows_of(spark, texts), q, 50, mask).collect():
            got.setdefault(r.query_id, {})[r.row] = r.score
        for i, text in enumerate(queries):
            assert got.get(i, {}) == pytest.approx(brute(texts, text, allowed))


def test_bm25_empty(spark):
    q = spark.createDataFrame([(0, "red")], "query_id bigint, query string")
    assert retrieve.bm25(rows_of(spark, []).where("false") if False else rows_of(spark, ["x"]).where("row < 0"), q).count() == 0


def test_dense_masks_ties_and_lengths(spark):
    vecs = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0]), (5, None)]
    m = spark.createDataFrame(vecs, "row bigint, embedding array<float>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id bigint, vector array<float>")
    assert [r.row for r in retrieve.dense(m, q, 10).orderBy("rank").collect()] == [0, 1, 3, 2]
    allowed = spark.createDataFrame([(2,), (3,), (99,)], "row bigint")
    assert [r.row for r in retrieve.dense(m, q, 1, allowed).collect()] == [3]
    assert retrieve.dense(m.where("false"), q).count() == 0 and retrieve.dense(m, q.where("false")).count() == 0


def test_fusion_keeps_first_seen_order(spark):
    lists = spark.createDataFrame([(1, 0, 10, 1), (1, 0, 11, 2), (1, 1, 11, 1), (1, 1, 10, 2), (1, 2, 12, 1)], "query_id bigint, list_id int, row bigint, rank int")
    out = retrieve.fuse(lists).orderBy("rank").collect()
    assert [r.row for r in out] == [10, 11, 12]
    assert out[0].score == pytest.approx(1 / 61 + 1 / 62)


def test_rerank(spark):
    c = spark.createDataFrame([(1, 7, 0.03, 1), (1, 8, 0.02, 2), (1, 9, 0.01, 3), (2, 7, 0.3, 1), (2, 8, 0.2, 2)], "query_id bigint, row bigint, score double, rank int")
    s = spark.createDataFrame([(1, {1: 1.5, 2: 0.0}), (2, None)], "query_id bigint, scores map<int,double>")
    out = rank.rerank(c, s).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.row, r.score) for r in out] == [(1, 8, 1.0), (1, 7, 0.0), (1, 9, 0.0), (2, 7, 0.3), (2, 8, 0.2)]


@pytest.mark.parametrize(
    ("scores", "passed"), [([0.6, 0.6], True), ([0.3], True), ([0.5, 0.5, 0.5], False), ([0.5, 0.5, 0.1, 0.1], True), ([0.0, 0.0], False), ([0.55, 0.54], True), ([], False)]
)
def test_gate(spark, scores, passed):
    assert spark.createDataFrame([(scores,)], "s array<double>").select(rank.gate(F.col("s")).alias("g")).first().g.passed is passed


def greedy(rel, vec, k, weight):
    chosen = [int(np.argmax(rel))]
    while len(chosen) < min(k, len(rel)):
        best = max((i for i in range(len(rel)) if i not in chosen), key=lambda i: (weight * rel[i] - (1 - weight) * max(float(vec[i] @ vec[j]) for j in chosen), -i))
        chosen.append(best)
    return chosen


def test_mmr_against_loop(spark):
    rng = np.random.default_rng(3)
    cases = []
    for n in (0, 1, 2, 7, 20):
        for weight in (0.0, 0.7, 1.0):
            cases.append((np.round(rng.random(n), 1), rng.normal(size=(n, 4)), weight))
    for rel, vec, weight in cases:
        df = spark.createDataFrame([([(float(r), [float(x) for x in v]) for r, v in zip(rel, vec)],)], "c array<struct<rel:double,vec:array<double>>>")
        for k in (0, 1, 5, 30):
            got = df.select(rank.mmr(F.col("c"), k, weight)).first()[0]
            assert got == (greedy(rel, vec, max(k, 1), weight) if len(rel) else [])


def test_diversify_only_beyond_top_k(spark):
    c = spark.createDataFrame([(1, 0, 0.9, 1), (1, 1, 0.85, 2), (1, 2, 0.8, 3)], "query_id bigint, row bigint, score double, rank int")
    v = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [0.99, 0.14, 0.0]), (2, [0.0, 1.0, 0.0])], "row bigint, embedding array<float>")
    two = rank.diversify(c, v, 2, Settings(mmr_lambda=0.5)).orderBy("rank").collect()
    assert [r.row for r in two] == [0, 2]
    assert [r.row for r in rank.diversify(c, v, 3).orderBy("rank").collect()] == [0, 1, 2]


HYPOTHESIS = "A paragraph that could stand in a document"


def asked(spark, provider, document_ids, reranked):
    """The answer to one question of 201 documents, of which the last is far from the question and near the hypothetical answer."""
    rng = np.random.default_rng(6)
    mine, other = provider.embed_batch(["zeta question", HYPOTHESIS]).astype(float)
    vectors = [(i, (mine + 0.05 * rng.normal(size=64)).tolist()) for i in range(200)] + [(200, other.tolist())]
    documents = spark.createDataFrame([(i, f"f{i}", "ready", 0) for i in range(201)], "doc_id bigint, filename string, status string, is_deleted int")
    chunks = spark.createDataFrame([(i, i, 1, f"filler {i}" if i < 200 else "TARGET passage", None, i) for i in range(201)], "id bigint, doc_id bigint, page int, text string, section_title string, embedding_row bigint")
    fields = "query_id bigint, query string, top_k int, answer_format string, document_ids array<bigint>, enable_llm_rerank boolean, logged_at timestamp"
    requests = spark.createDataFrame([(1, "zeta question", 5, None, document_ids, reranked, None)], fields)
    return pipeline.answer(requests, documents, chunks, spark.createDataFrame(vectors, "embedding_row bigint, embedding array<float>"), provider).first()


def test_a_request_searches_its_own_documents(spark):
    got = asked(spark, FakeProvider(64), [200], False)
    assert got.refusal_reason is None and [c.document_id for c in got.citations] == [200]


def test_weak_evidence_tries_a_hypothetical_answer(spark):
    all_good = '{"scores": [' + ", ".join(f'{{"id": "{i}", "score": 0.9}}' for i in range(40)) + "]}"
    rules = (("^Write a short", HYPOTHESIS), ("(?s)^Score.*TARGET", all_good))
    assert asked(spark, FakeProvider(64, rules), None, True).refusal_reason is None
    assert asked(spark, FakeProvider(64, rules[1:]), None, True).refusal_reason == "insufficient_evidence"


def written(spark):
    """Records that stages have written to shuffles so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def searched(spark, parts):
    """Records written to shuffles for 300 questions about one frequent word, each with so many equal parts, over 600 rows in 60 tasks."""
    texts = [f"seal number{i}" for i in range(600)]
    rows = rows_of(spark, texts).repartition(60)
    matrix = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(600)], "row bigint, embedding array<float>").repartition(60)
    queries = spark.createDataFrame([(i, p, f"seal number{i}", [1.0, float(i)]) for i in range(300) for p in range(parts)], "query_id bigint, part int, query string, vector array<float>")
    before = written(spark)
    found = retrieve.hybrid(rows, matrix, queries, settings=Settings(list_depth=5)).where("rank = 1").collect()
    assert len(found) == 300
    return written(spark) - before


def test_hybrid_writes_no_pairs_of_questions_and_rows(spark):
    assert searched(spark, 1) < 50_000 < 300 * 600


def test_hybrid_search_of_tables_writes_no_pairs(spark, tmp_path):
    n = 1_000  # each row is a question
    spark.createDataFrame([(i, "ready", 0) for i in range(n)], "doc_id bigint, status string, is_deleted int").write.parquet(f"{tmp_path}/documents.parquet")
    fields = "doc_id bigint, embedding_row bigint, text string, section_title string"
    spark.createDataFrame([(i, 100 * i, "seal", "seal") for i in range(n)], fields).repartition(30).write.parquet(f"{tmp_path}/chunks.parquet")
    vectors = [(100 * i, [float(np.cos(i % 20)), float(np.sin(i % 20))]) for i in range(n)]
    spark.createDataFrame(vectors, "embedding_row bigint, embedding array<float>").repartition(30).write.parquet(f"{tmp_path}/chunk_vectors.parquet")
    before = written(spark)
    found = catalog.hybrid_search(spark, str(tmp_path)).where("rank = 1").collect()
    assert written(spark) - before < 400_000 < n * n
    # of the 50 rows with the question's vector, the first is the best in both lists
    assert {r.query_id: r.row for r in found} == {100 * i: 100 * (i % 20) for i in range(n)}


def test_equal_parts_are_searched_once(spark):
    assert searched(spark, 4) < 2 * searched(spark, 1)


def batches_of(names, *columns, size=7):
    table = pa.table(dict(zip(names, columns)))
    return table.to_batches(max_chunksize=size)


def kept_of(run, batches):
    out = {}
    for batch in run(iter(batches)):
        for r in batch.to_pylist():
            out.setdefault(r["key"], []).append((r["row"], r["score"]))
    return out


@pytest.mark.parametrize("scale", [1.0, 1e20])
def test_dense_task_against_brute_force(monkeypatch, scale):
    monkeypatch.setattr(retrieve, "ROWS", 50)
    monkeypatch.setattr(retrieve, "TILE", 20)
    monkeypatch.setattr(retrieve, "BLOCK", 4)
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(300, 6)), 1).astype(np.float32)  # many ties
    x[::9] = x[0]
    x[5] *= np.float32(1e4)
    x[8, 2] = np.nan
    x *= np.float32(scale)
    q = np.concatenate([np.round(rng.normal(size=(9, 6)), 1), np.zeros((1, 6)), 1e3 * np.ones((1, 6))]) * scale
    got = kept_of(retrieve._best(q, 5), batches_of(["row", "embedding"], range(1000, 1300), pa.array(x.tolist(), pa.list_(pa.float32()))))
    for j in range(len(q)):
        scores = x.astype(float) @ q[j]
        best = sorted((i for i in range(300) if not np.isnan(scores[i])), key=lambda i: (-round(scores[i], 9), i))[:5]
        assert [s for _, s in got[j]] == pytest.approx([scores[i] for i in best])
        if scale == 1.0:
            assert [r - 1000 for r, _ in got[j]] == best


def test_bm25_task_against_brute_force(monkeypatch):
    monkeypatch.setattr(retrieve, "ROWS", 50)
    rng = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    texts = [rng.choices(words, weights=[1 / (i + 1) for i in range(40)], k=rng.randint(0, 25)) for _ in range(300)]
    asked = [" ".join(rng.choices(words, k=n)) for n in (1, 2, 5, 20, 60)] + ["w0 w1", "w39"]
    n, avgdl = len(texts), sum(map(len, texts)) / len(texts)
    df = np.array([sum(w in t for t in texts) for w in words], float)
    bags = [(np.array([words.index(t) for t in sorted(set(a.split()))]), np.array([a.split().count(t) for t in sorted(set(a.split()))], float)) for a in asked]
    run = retrieve._best_matches(bags, words, np.maximum(0.01, np.log1p((n - df + 0.5) / (df + 0.5))), avgdl, 5, 1.5, 0.75)
    got = kept_of(run, batches_of(["row", "dl", "terms"], range(300), [len(t) for t in texts], texts))
    for j, text in enumerate(asked):
        scores = brute([" ".join(t) for t in texts], text)
        best = sorted(scores, key=lambda i: (-round(scores[i], 9), i))[:5]
        assert [r for r, _ in got[j]] == best and [s for _, s in got[j]] == pytest.approx([scores[i] for i in best])
