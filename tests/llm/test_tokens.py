import os

import pytest

from lodestrata.llm import mix, tokens

PATH = f"{tokens.TOKENIZERS}/{tokens.BYTE_BPE_50K}"
needs_vocabulary = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary")
TEXTS = ["", None, "Hello  world\n\n x \t y", "<|endoftext|> aaaa aaaaaaaaaa", "don't we'll  naïve café 　x", "a" * 5000, "été 👍🏽 附件 60", " lead", "trail ", "\n", "x\r\n \n y"]


@needs_vocabulary
def test_ids_equal_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, ids string")
    got = {r.doc_id: r.ids for r in tokens.encode(df.select("doc_id", "text", "ids"), PATH).collect()}
    assert got == {i: library.encode(t, add_special_tokens=False).ids if t else [] for i, t in enumerate(TEXTS)}
    counts = {r.doc_id: r.tokens for r in tokens.count(df, PATH).collect()}
    assert counts == {i: len(v) for i, v in got.items()}


@needs_vocabulary
def test_empty_table_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id bigint, text string")
    assert tokens.encode(df.where("false"), PATH).count() == 0
    assert sorted((r.doc_id or 0, len(r.ids)) for r in tokens.encode(df, PATH).collect()) == [(0, 1), (1, 2), (1, 2)]


def test_pieces_keep_words():
    for text in filter(None, TEXTS):
        plain, spaced = tokens.pieces_of(text)
        words = [w for p in [*plain, *(" " + s for s in spaced)] for w in tokens.words_of(p)]
        assert words == tokens.words_of(text)


def brute_seats(weights, seats):
    out = dict.fromkeys(weights, 0)
    for _ in range(seats):
        k = max((k for k in weights if weights[k] and weights[k] > 0), key=lambda k: (weights[k] / (2 * out[k] + 1), [-ord(c) for c in str(k)]))
        out[k] += 1
    return out


@pytest.mark.parametrize("weights", [{"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1.0, "b": 1.0}, {"a": 0.001, "b": 5.0, "c": 0.0, "d": None}, {"a": 7}])
@pytest.mark.parametrize("seats", [0, 1, 2, 5, 97])
def test_sainte_lague_against_dealing_out(weights, seats):
    got = mix.sainte_lague(weights, seats)
    assert sum(got.values()) == seats
    assert got == brute_seats(weights, seats)


@needs_vocabulary
def test_mix_shares(spark):
    docs = [(i, "word " * (5 + i % 7), ["big", "mid", "small"][0 if i % 10 < 7 else 1 if i % 10 < 9 else 2]) for i in range(600)] + [(1000, None, "big"), (1001, "", None)]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("m", "big", 0.4, 2, 0.5), ("m", "mid", 0.3, 2, 0.5), ("m", "small", 0.2, 2, 0.5), ("m", "none", 0.1, 2, 0.5), (None, "big", 1.0, 1, 1.0)], "mix_name string, source string, target_share double, max_repeats int, size_ratio double")
    picked, report = mix.mix(docs, targets, PATH)
    rows = {r.source: r for r in report.collect()}
    assert rows["big"].of_wanted == pytest.approx(0.4, abs=0.01) and rows["mid"].of_wanted == pytest.approx(0.3, abs=0.01)
    assert rows["small"].of_wanted == pytest.approx(0.2, abs=0.01) and rows["none"].of_wanted == 0
    # the source that has no documents leaves a shortfall: of what there is, the others have more
    assert rows["big"].reached_share == pytest.approx(4 / 9, abs=0.01) and sum(r.reached_share for r in rows.values()) == pytest.approx(1)
    assert max(r.repeats for r in picked.collect()) <= 2
    assert {tuple(r) for r in picked.collect()} == {tuple(r) for r in mix.mix(docs, targets, PATH)[0].collect()}
    assert mix.mix(docs.where("false"), targets, PATH)[0].count() == 0
