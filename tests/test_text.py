import re

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import masks, parsing, policy, text


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


def test_tokens(spark):
    assert one(spark, "Pay $25,000 for v3.14, don't re-send the KÄSE", text.tokens) == ["pay", "25,000", "v3.14", "don't", "re", "send", "k", "se"]
    assert one(spark, None, text.tokens) == []
    assert one(spark, "", text.tokens) == []


def test_stopwords_are_distinct():
    assert len(set(text.STOPWORDS)) == len(text.STOPWORDS) == 67


def test_sentences(spark):
    assert one(spark, "Dr. Who came. It cost 3.14! [1] Ok? yes", text.sentences) == ["Dr. Who came.", "It cost 3.", "14!", "[1] Ok? yes"]
    assert one(spark, "  ", text.sentences) == []


def test_citations(spark):
    assert one(spark, "a [1] b [2, 3][1] c [x]", text.citations) == [1, 2, 3, 1]
    assert one(spark, "a [1]  b", text.strip_citations) == "a b"
    assert one(spark, "Why [1]?", text.looks_factual) is False
    assert one(spark, "[1]", text.looks_factual) is False
    assert one(spark, "So it is [1].", text.looks_factual) is True


IBAN = "GB82 WEST 1234 5698 7654 32"


@pytest.mark.parametrize(
    ("given", "wanted", "entities"),
    [
        ("mail a.b@c.org now", "mail [EMAIL] now", ["email"]),
        ("ssn 123-45-6789", "ssn [SSN]", ["ssn"]),
        ("call +1 555 123 4567", "call [PHONE]", ["phone"]),
        (f"pay {IBAN}", "pay [IBAN]", ["iban"]),
        ("pay GB82 WEST 1234 5698 7654 33", "pay GB82 WEST 1234 5698 7654 33", []),
        ("card 4111 1111 1111 1111!", "card [CREDIT_CARD]!", ["credit_card"]),
        ("card 4111 1111 1111 1112!", "card 4111 1111 1111 1112!", []),
        ("", "", []),
        (None, None, []),
    ],
)
def test_masks(spark, given, wanted, entities):
    row = masks.with_masked(spark.createDataFrame([(given,)], "t string"), "t").first()
    assert (row.masked, row.entities) == (wanted, entities)


def test_masks_are_stable(spark):
    row = masks.with_masked(spark.createDataFrame([("a@b.co [EMAIL] [SSN]",)], "t string"), "t").first()
    again = masks.with_masked(spark.createDataFrame([(row.masked,)], "t string"), "t").first()
    assert again.masked == row.masked and again.entities == []


def test_policy(spark):
    rows = [("Should I sue over the medical issue?",), ("the issue of the valve",), ("what is the clause, help me",), ("hello",), (None,)]
    out = [r for r in policy.apply_policy(spark.createDataFrame(rows, "query string")).collect()]
    by = {r.masked: r for r in out}
    assert by["Should I sue over the medical issue?"].disclaimer == "medical" and by["Should I sue over the medical issue?"].refuse_reason == "personalized_advice"
    assert by["the issue of the valve"].disclaimer == "legal"  # keywords count inside words
    assert by["what is the clause, help me"].ask_fallback
    assert by["hello"].disclaimer is None and by[""].disclaimer is None


def test_disclaimer_once(spark):
    put = lambda a: one(spark, a, lambda c: policy.with_disclaimer(c, F.lit("legal")))
    assert put("x").endswith("\n\nx") and put(put("x")) == put("x") and put("") == policy.DISCLAIMERS["legal"]
    assert one(spark, put("x"), policy.exempt_sentences) == len(re.findall(r"\.(?: |$)", policy.DISCLAIMERS["legal"]))


def test_replies(spark):
    read = lambda s: one(spark, s, lambda c: parsing.transform_reply(c, F.lit("raw")))
    assert tuple(read("nonsense")) == ("search", None, "raw", [])
    assert tuple(read('{"intent":"NO_SEARCH","sub_intent":"null","rewritten_query":" "}')) == ("no_search", None, "", [])
    assert tuple(read('{"intent":"what","sub_intent":"List","rewritten_query":" a ","expansion_queries":["", " b ", "c", "d", "e"]}')) == ("search", "List", "a", ["b", "c", "d"])
    scores = lambda s: one(spark, s, parsing.rerank_reply)
    assert scores('{"scores":[{"id":"0","score":1.7},{"id":"x","score":1},{"id":"1","score":"bad"},{"id":2,"score":-1},{"id":"0","score":0.5}]}') == {0: 0.5, 2: 0.0}
    assert scores('{"other":1}') is None and scores('{"scores":[]}') == {}
    assert one(spark, '{"0":true,"1":"TRUE","2":"no","3":1}', parsing.entailment_reply) == {"0": True, "1": True, "2": False, "3": False}
    fmt = lambda f, sub: spark.range(1).select(parsing.output_format(F.lit(f).cast("string"), F.lit(sub).cast("string"))).first()[0]
    assert [fmt("auto", "list"), fmt(None, "comparison"), fmt("json", "list"), fmt("auto", None)] == ["list", "table", "json", "prose"]
    shaped = lambda r, f: tuple(spark.createDataFrame([(r, f)], "r string, f string").select(parsing.structured_reply(F.col("r"), F.col("f")).alias("s")).first().s)
    assert shaped('{"answer":"a [1]","items":[{"text":"x"}]}', "list") == ("a [1]", '{"items":[{"text":"x"}]}')
    assert shaped("plain", "table")[0] == "plain" and shaped("plain", "prose") == ("plain", None)
