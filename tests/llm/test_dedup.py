import datetime as dt
import random
import re

import numpy as np

from lodestrata.llm import dedup


def brute(docs, chunks):
    words = {}
    for d, o, t in sorted({(d, o, t) for d, o, t in chunks if t is not None and d is not None}, key=lambda x: (x[0], x[1], x[2])):
        words.setdefault(d, []).extend(re.findall(r"[^\W_]+", t.lower()))
    seqs = {d: {tuple(w[i : i + 3]) for i in range(len(w) - 2)} for d, w in words.items()}
    accepted, out = [], set()
    for d, sha, _ in sorted(docs, key=lambda x: (x[2], x[0])):
        s, hits = seqs.get(d, set()), []
        for a, a_sha in accepted:
            t = seqs.get(a, set())
            if sha and a_sha and sha.lower() == a_sha.lower() or s and t and len(s & t) >= 0.7 * len(s | t):
                hits.append(a)
        if hits:
            out |= {(min(a, d), max(a, d)) for a in hits}
        else:
            accepted.append((d, sha))
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    docs, chunks, n = [], [], 0
    originals = [[rng.choice(vocabulary) for _ in range(rng.randint(20, 160))] for _ in range(25)]
    for k in range(110):
        base = list(rng.choice(originals)) if k >= 25 else list(originals[k])
        for _ in range(rng.choice([0, 0, 1, 2, 8]) if k >= 25 else 0):
            base[rng.randrange(len(base))] = rng.choice(vocabulary)
        doc = rng.randrange(10**6)
        day = dt.datetime(2025, 1, 1 + rng.randrange(20), rng.randrange(24))
        docs.append((doc, rng.choice([None, None, f"aB{rng.randrange(60)}", f"Ab{rng.randrange(60)}", " "]), day))
        cut = rng.choice([30, 47, 200])
        for o, at in enumerate(range(0, len(base), cut)):
            chunks.append((n, doc, o, " ".join(base[at : at + cut]).title()))
            n += 1
            if rng.random() < 0.05:
                chunks.append((n, *chunks[-1][1:]))
                n += 1
    docs += [(10**7, None, dt.datetime(2025, 1, 1)), (10**7 + 1, None, dt.datetime(2025, 1, 2))]
    chunks += [(n + 1, 10**7, 0, "hi"), (n + 2, 10**7 + 1, 0, "hi"), (n + 3, 10**7, 1, None), (n + 4, None, 0, "lost")]
    return docs, chunks


def frames(spark, docs, chunks):
    return (
        spark.createDataFrame([(d, None if s == " " else s, t, "x") for d, s, t in docs], "doc_id bigint, sha256 string, ingested_at timestamp, text string"),
        spark.createDataFrame(chunks, "id bigint, doc_id bigint, ordinal int, text string"),
    )


def test_against_brute_force(spark):
    docs, chunks = corpus(5)
    wanted = brute([(d, None if s == " " else s, t) for d, s, t in docs], [c[1:] for c in chunks])
    d, c = frames(spark, docs, chunks)
    got = {tuple(r) for r in dedup.found(d, c, batches=2).collect()}
    assert got == wanted and len(wanted) > 40


def test_empty(spark):
    d, c = frames(spark, *corpus(6))
    assert dedup.found(d.where("false"), c.where("false"), batches=1).count() == 0
    assert dedup.found(d, c.where("false"), batches=1).count() > 0  # by sha256 alone


def test_daily_batches_and_a_store_that_another_process_goes_on_with(spark, tmp_path):
    docs, chunks = corpus(7)
    wanted = brute([(d, None if s == " " else s, t) for d, s, t in docs], [c[1:] for c in chunks])
    d, c = frames(spark, docs, chunks)
    days = sorted({t.date() for _, _, t in docs})
    got, path = set(), f"file://{tmp_path}/store"
    dedup.Store.create(spark, path, 4)
    for low, high in zip(days[::5], [*days[5::5], dt.date(2030, 1, 1)]):
        batch = d.where((d.ingested_at >= dt.datetime.combine(low, dt.time())) & (d.ingested_at < dt.datetime.combine(high, dt.time())))
        store = dedup.Store(spark, path)  # nothing but the folder is known
        repeats = dedup.add_batch(batch, c.join(batch.select("doc_id"), "doc_id", "left_semi"), store)
        got |= {(min(r), max(r)) for r in map(tuple, repeats.collect())}
    assert got == wanted and len(dedup.Store(spark, path).batches) == len(days[::5])


def test_hot_fingerprints_chains_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(dedup, "HOT", 15)
    monkeypatch.setattr(dedup, "SETTLED", 60)
    rng = random.Random(4)
    text, docs, chunks = [f"c{i}" for i in range(120)], [], []
    for k in range(50):  # each version is near the ones beside it only
        docs.append((k, None, dt.datetime(2025, 1, 1 + k // 10, k % 10)))
        chunks.append((k, k, 0, " ".join(text)))
        for _ in range(3):
            text[rng.randrange(120)] = f"n{rng.random()}"
    wanted = brute(docs, [c[1:] for c in chunks])
    assert {tuple(r) for r in dedup.found(*frames(spark, docs, chunks), batches=1).collect()} == wanted and len(wanted) > 20


def test_a_chain_of_300_versions(spark):
    rng = random.Random(5)
    text, docs, chunks = [f"c{i}" for i in range(60)], [], []
    for k in range(300):
        docs.append((k, None, dt.datetime(2025, 1, 1) + dt.timedelta(hours=k)))
        chunks.append((k, k, 0, " ".join(text)))
        for _ in range(2):
            text[rng.randrange(60)] = f"n{rng.random()}"
    assert {tuple(r) for r in dedup.found(*frames(spark, docs, chunks)).collect()} == brute(docs, [c[1:] for c in chunks])


def test_very_long_and_repetitive_documents(spark, monkeypatch):
    monkeypatch.setattr(dedup, "STRETCH", 4)
    monkeypatch.setattr(dedup, "SLICE", 200)
    rng = random.Random(8)
    docs, chunks = [], []

    def add(doc, words, cut):
        docs.append((doc, None, dt.datetime(2025, 1, 1 + doc)))
        chunks.extend((len(chunks) + o, doc, o, " ".join(words[at : at + cut])) for o, at in enumerate(range(0, len(words), cut)))

    base = [f"w{rng.randrange(3000)}" for _ in range(4000)]
    edited = [x if rng.random() > 0.04 else f"x{rng.random()}" for x in base]
    again = [f"s{i % 90}" for i in range(8050)]
    add(0, base, 90), add(1, edited, 70), add(2, base[:2900], 1), add(3, again, 100), add(4, again + [f"s{i}" for i in range(20)] * 12, 8300), add(5, base + base, 50)
    wanted = brute(docs, [c[1:] for c in chunks])
    assert {tuple(r) for r in dedup.found(*frames(spark, docs, chunks)).collect()} == wanted and {(0, 1), (0, 5), (3, 4)} <= wanted


def test_pairs_share_what_they_need():
    rng = np.random.default_rng(3)
    for a, b in [(20, 14), (25, 20), (28, 40), (33, 33), (60, 50), (95, 70), (99, 141), (100, 100), (150, 110), (300, 230), (2000, 1500), (5000, 5000)]:
        for _ in range(60):
            both = -(-7 * (a + b) // 17)
            u = np.unique(rng.integers(0, 2**40, a + b - both + 9).astype(np.uint64))[: a + b - both]
            order = rng.permutation(len(u))
            x, y = np.sort(u[order[:a]]), np.sort(np.concatenate([u[order[:both]], u[order[a:]]]))
            row, prints = dedup.winnow(np.concatenate([x, y]), np.array([len(x), len(y)]), np.array([len(x), len(y)]))
            shared = len(np.intersect1d(prints[row == 0], prints[row == 1]))
            assert shared >= dedup.need(np.array([max(a, b)]))[0], (a, b)


def test_bloom_has_no_false_negatives():
    rng = np.random.default_rng(1)
    inside, outside = rng.integers(0, 2**40, 5000).astype(np.uint64), rng.integers(2**41, 2**42, 5000).astype(np.uint64)
    bits = dedup.bloom_build(inside)
    assert dedup.bloom_test(bits, inside).all() and dedup.bloom_test(bits, outside).mean() < 0.02


def test_evenly_spread_edits(spark):
    rng = random.Random(9)
    docs, chunks = [], []
    for k in range(60):
        base = [f"v{rng.randrange(5000)}" for _ in range(rng.choice([100, 200]))]
        step = rng.choice([15, 16])
        edited = [w for i, x in enumerate(base) for w in ([x] if i % step else [x, f"n{rng.random()}"[:9]] if k % 2 else [])]
        for half, words in enumerate((base, edited)):
            docs.append((2 * k + half, None, dt.datetime(2025, 1, 1 + half)))
            cut = rng.choice([40, 300])
            chunks += [(len(chunks) + o, 2 * k + half, o, " ".join(words[at : at + cut])) for o, at in enumerate(range(0, len(words), cut))]
    wanted = brute(docs, [c[1:] for c in chunks])
    assert len(wanted) > 20 and {tuple(r) for r in dedup.found(*frames(spark, docs, chunks), batches=2).collect()} == wanted
