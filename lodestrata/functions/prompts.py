"""Prompts for the language model, assembled as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.functions.policy import DISCLAIMERS

RULES = "Answer from the numbered passages only and cite each statement by its passage, e.g. [1]. If the passages don't hold the answer, say so."
SHAPES = {
    "prose": RULES,
    "list": RULES + ' Reply in JSON: "answer" (a bullet list with citations) and "items" (objects with "text" and "citations").',
    "table": RULES + ' Reply in JSON: "answer" (a table in Markdown with citations) and "rows" (objects with "cells" and "citations").',
    "json": RULES + ' Reply in JSON: "answer" (text with citations) and "structured" (an object).',
}


def numbered(texts: Column) -> Column:
    """Passages with their numbers from 1."""
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(t, F.lit("")))), "\n\n")


def answer_prompt(query: Column, texts: Column, fmt: Column, disclaimer: Column) -> Column:
    rules = F.lit(SHAPES["prose"])
    for name in ("list", "table", "json"):
        rules = F.when(fmt == name, F.lit(SHAPES[name])).otherwise(rules)
    put = F.lit(None).cast("string")
    for kind, text in DISCLAIMERS.items():
        put = F.when(disclaimer == kind, F.lit(f"Begin with: {text}")).otherwise(put)
    return F.concat_ws("\n\n", rules, F.concat(F.lit("Passages:\n"), numbered(texts)), F.concat(F.lit("Question: "), query), put)


def rerank_prompt(query: Column, texts: Column) -> Column:
    listing = F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), F.coalesce(t, F.lit("")))), "\n\n")
    return F.concat(F.lit('Score each passage from 0 to 1 for the question. Reply in JSON: {"scores": [{"id": "0", "score": 0.5}]}\n\nQuestion: '), query, F.lit("\n\n"), listing)


def transform_prompt(query: Column) -> Column:
    return F.concat(F.lit("Classify the question (SEARCH, NO_SEARCH, REFUSE), rewrite it for retrieval, give up to three paraphrases. Reply in JSON.\n\nQuestion: "), query)


def policy_prompt(topic: Column, query: Column) -> Column:
    return F.concat(F.lit('Does the question ask for personal advice? Reply in JSON: {"action": "SAFE" or "DISCLAIMER" or "REFUSE"}\n\nTopic: '), topic, F.lit("\n\nQuestion: "), query)


def hyde_prompt(query: Column) -> Column:
    return F.concat(F.lit("Write a short factual paragraph that could stand in a document and answers the question.\n\nQuestion: "), query)


def entailment_prompt(sentences: Column, contexts: Column) -> Column:
    pairs = F.zip_with(sentences, contexts, lambda s, c: F.concat(F.lit("sentence: "), s, F.lit("\ncontext: "), c))
    listing = F.array_join(F.transform(pairs, lambda p, i: F.concat(F.lit("id: "), i.cast("string"), F.lit("\n"), p)), "\n")
    return F.concat(F.lit("For each pair, does the context support the sentence? Reply in JSON, ids to true or false.\n"), listing)
