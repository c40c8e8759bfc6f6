import numpy as np

from lodestrata.llm import ann, queries


def data(seed=0, n=3000, d=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    for k in range(0, n - 10, 20):  # near copies
        x[k + 1 : k + 4] = x[k] + 0.05 * rng.normal(size=(3, d)).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def exact(x, k):
    s = x.astype(np.float64) @ x.T.astype(np.float64)
    np.fill_diagonal(s, -2)
    return np.argsort(-s, axis=1, kind="stable")[:, :k], s


def test_graph_recall():
    x = data(n=1500)
    padded, edges, entry = ann.build_graph(x)
    assert (edges[:-1] < len(x)).sum(axis=1).max() <= ann.DEGREE
    ids, sims = ann.beam_search(padded, edges, x, np.concatenate([np.full((len(x), 1), entry), edges[:-1]], axis=1))
    top, s = exact(x, 3)
    near = np.take_along_axis(s, top, 1) >= 0.9
    hit = (top[:, :, None] == ids[:, None, :]).any(axis=2)
    assert hit[near].mean() > 0.97 and (np.diff(sims, axis=1) <= 1e-6).all()


def test_small_graphs():
    for n in (1, 2, 5):
        padded, edges, entry = ann.build_graph(data(n=30)[:n])
        ids, _ = ann.beam_search(padded, edges, data(n=30)[:n], np.full((n, 1), entry))
        assert set(ids[0][ids[0] < n].tolist()) == set(range(n))


def test_found_recall_ties_and_dirt(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 300)
    x = data(3, 1500)
    rows = [(int(i) * 3, [float(v) for v in x[i] * (1 + i % 4)]) for i in range(len(x))]
    copies = [(100_000 + i, [1.0] + [0.0] * 15) for i in range(9)]
    dirt = [(200_000, [0.0] * 16), (200_001, None), (200_002, [1.0]), (None, [1.0] * 16), (200_003, [float("nan")] * 16)]
    df = spark.createDataFrame(rows + copies + dirt, "embedding_row bigint, embedding array<float>")
    got = ann.neighbours(df, least=0.9, dim=16).collect()
    pairs = {(min(r.row, r.neighbour), max(r.row, r.neighbour)) for r in got}
    top, s = exact(x, 5)
    wanted = {(min(i, int(j)) * 3, max(i, int(j)) * 3) for i in range(len(x)) for j in top[i] if s[i, j] >= 0.9}
    mine = {p for p in pairs if p[1] < 100_000}
    assert len(wanted & mine) / len(wanted) > 0.95 and len(wanted & mine) / len(mine) > 0.95
    # equal vectors: the five smallest other rows of each
    expected = {(min(a, b), max(a, b)) for a in range(9) for b in [c for c in range(9) if c != a][:5]}
    assert {(a - 100_000, b - 100_000) for a, b in pairs if a >= 100_000} == expected
    assert not any(r.row >= 200_000 or r.neighbour >= 200_000 for r in got)


def test_empty_and_queries(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "embedding_row bigint, embedding array<float>")
    assert ann.neighbours(df.where("false"), dim=2).count() == 0
    q = spark.createDataFrame([(1,), (None,)], "embedding_row bigint")
    assert [(r.row, r.neighbour, r["rank"]) for r in ann.neighbours(df, k=2, queries=q, dim=2).orderBy("rank").collect()] == [(1, 2, 1), (1, 3, 2)]


def test_neighbours_of_many_cells(spark, monkeypatch, tmp_path):
    # shards a fiftieth of their size stand for a table of fifty times the rows
    monkeypatch.setattr(ann, "SHARD", 24)
    monkeypatch.setattr(ann, "WIDE_SHARD", 96, raising=False)
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(6000, 10)) @ rng.normal(size=(10, ann.DIM))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "embedding_row bigint, embedding array<float>")
    df.write.parquet(f"{tmp_path}/chunk_vectors.parquet")
    df.select("embedding_row").where("embedding_row % 10 = 0").write.parquet(f"{tmp_path}/chunks.parquet")
    got = {(r.row, r.neighbour) for r in queries.p3_neighbours(spark, str(tmp_path)).collect()}
    top, _ = exact(x, 5)
    wanted = {(i, int(j)) for i in range(0, len(x), 10) for j in top[i]}
    assert len(wanted & got) / len(wanted) > 0.9


def test_cells_come_in_two_levels(spark):
    x = data(7, 4000, 16)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row bigint, embedding array<float>")
    upper, lower, starts = ann.fit_cells(df, len(x), 100, 16)
    assert len(upper) == 10 and 60 < len(lower) < 140 and starts[-1] == len(lower) and (np.diff(starts) > 0).all()
    cells = ann.nearest_cells(x, upper, lower, starts, 3)
    best = (x @ lower.T).argmax(axis=1)
    assert (cells[:, 0] == best).mean() > 0.9 and (cells >= 0).all() and np.bincount(cells[:, 0]).max() < 400


def test_cells_that_no_centre_tells_apart(spark, monkeypatch):
    monkeypatch.setattr(ann, "SPLIT", 2)
    rng = np.random.default_rng(5)
    x = np.concatenate([data(2, 200, 16), data(1, 1, 16)[:1] + 0.002 * rng.normal(size=(400, 16)).astype(np.float32)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "embedding_row bigint, embedding array<float>")
    got = {(r.row, r.neighbour) for r in ann.neighbours(df, dim=16, shard=40, probes=3).collect()}
    top, _ = exact(x, 5)
    assert len({(i, int(j)) for i in range(200, 600) for j in top[i]} & got) / 2000 > 0.95
