import random
from collections import defaultdict

from lodestrata.llm import lines
from lodestrata.session import Scratch


def tables(spark, rows, docs):
    chunks = spark.createDataFrame(rows, "id bigint, doc_id bigint, text string")
    return chunks, spark.createDataFrame(docs, "doc_id bigint, source string")


def test_repeated_lines_and_blocks(spark):
    docs = [(d, "s" if d < 8 else None) for d in range(10)] + [(20, "t")]
    rows = [(d, d, f"Own line number {'abcdefghij'[d] * 3} here now\n\nAll  rights reserved by us {d}\nshared (second) line of four words") for d in range(10)]
    rows += [(30, 20, "All rights reserved by us"), (31, None, "All rights reserved by us"), (32, 1, None), (33, 2, "ALL RIGHTS RESERVED, BY US")]
    chunks, documents = tables(spark, rows, docs)
    got = {(r.chunk_id, r.line_no) for r in lines.found(chunks, documents).collect()}
    assert got == {(d, n) for d in range(8) for n in (3, 4)} | {(33, 1)}
    _, blocks = lines.repeated_blocks(chunks, documents, Scratch(spark, "lines"))
    assert sorted((b["size"], b.n_docs) for b in blocks.collect()) == [(1, 8), (1, 8), (2, 8)]
    clean = {r.chunk_id: (r.text, r.removed) for r in lines.cleaned(chunks, documents).collect()}
    assert clean[0] == ("Own line number aaa here now\n", 2) and clean[32] == (None, 0) and clean[30][1] == 0


def test_thresholds(spark):
    line = "one two three four"
    few, docs = tables(spark, [(d, d, line) for d in range(4)], [(d, "s") for d in range(4)])
    assert lines.found(few, docs).count() == 0  # fewer than five documents
    chunks, docs = tables(spark, [(d, d, line) for d in range(5)], [(d, "s") for d in range(101)])
    assert lines.found(chunks, docs).count() == 0  # less than a twentieth
    short, docs = tables(spark, [(d, d, "one two three 4") for d in range(9)], [(d, "s") for d in range(9)])
    assert lines.found(short, docs).count() == 0  # three words
    assert lines.found(short.where("false"), docs).count() == 0 and lines.found(short, docs.where("false")).count() == 0


def test_suffix_array_against_sorting(spark):
    runs = spark.createDataFrame([("s", 1, 1, [3, 1, 2], [1, 2, 3]), ("s", 2, 2, [1, 2], [1, 2]), ("s", 3, 3, [3, 1], [1, 2])], "source string, chunk_id bigint, doc_id bigint, ids array<bigint>, nos array<int>")
    got = [(r.suffix, r.lcp, r.n) for r in lines.suffix_array(runs).orderBy("suffix").collect()]
    every = sorted(tuple(ids[i:]) for ids in ([3, 1, 2], [1, 2], [3, 1]) for i in range(len(ids)))
    distinct = sorted(set(every))
    lcp = [0] + [next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b))) for a, b in zip(distinct, distinct[1:])]
    assert got == [(list(s), k, every.count(s)) for s, k in zip(distinct, lcp)]


def test_blocks_against_brute_force(spark):
    rng = random.Random(6)
    kinds = [" ".join(f"{a}{b}word" for b in "abcd") for a in "klmnopqrst"]
    rows, docs = [], [(d, "s" if d % 3 else "t") for d in range(60)]
    for d, _ in docs:
        for c in range(rng.randint(0, 2)):
            at = rng.randrange(6)
            text = [rng.choice(kinds) for _ in range(rng.randint(0, 3))] + (kinds[at : at + 3] if rng.random() < 0.6 else []) + ["x"] * rng.randint(0, 1)
            rows.append((10 * d + c, d, "\n".join(text)))
    chunks, documents = tables(spark, rows, docs)
    of, n = dict(docs), defaultdict(int)
    for _, s in docs:
        n[s] += 1
    where = defaultdict(set)
    for _, d, text in rows:
        for line in text.split("\n"):
            if len(line) > 1:
                where[of[d], line].add(d)
    wanted = {(c, k) for c, d, text in rows for k, line in enumerate(text.split("\n"), 1) if len(line) > 1 and len(where[of[d], line]) >= max(5, 0.05 * n[of[d]])}
    assert {(r.chunk_id, r.line_no) for r in lines.found(chunks, documents).collect()} == wanted and wanted
    _, blocks = lines.repeated_blocks(chunks, documents, Scratch(spark, "lines"))
    longest = defaultdict(set)
    for c, d, text in rows:
        run = text.split("\n")
        for i in range(len(run)):
            for j in range(i + 1, len(run) + 1):
                if all(len(x) > 1 for x in run[i:j]):
                    longest[of[d], tuple(run[i:j])].add(d)
    good = {k: len(v) for k, v in longest.items() if len(v) >= max(5, 0.05 * n[k[0]])}
    # a block that always goes on in the same way needs no row of its own
    got = sorted((b.source, b["size"], b.n_docs) for b in blocks.collect())
    every = [(s, len(b), k) for (s, b), k in good.items()]
    assert all(x in every for x in got) and {x for x in every if x[1] == 1} <= set(got) and max(x[1] for x in every) == max(x[1] for x in got)
