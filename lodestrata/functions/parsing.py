"""Answers of the language model, parsed without ever failing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.functions.text import strip

def transform_reply(reply: Column, raw_query: Column) -> Column:
    """struct(intent, sub_intent, rewritten_query, expansion_queries).

    Without a readable intent: a search for the raw query. An unknown intent is search; a null-like sub-intent is null, any other stays as
    written; an empty rewrite is the raw query. What isn't searched for has no rewrite. Of the expansions the first three that aren't empty,
    stripped.
    """
    schema = "intent string, sub_intent string, rewritten_query string, expansion_queries array<string>"
    p = F.from_json(reply, schema)
    readable = p["intent"].isNotNull()
    known = F.upper(strip(p["intent"]))
    intent = F.when(readable & (known == "NO_SEARCH"), F.lit("no_search")).when(readable & (known == "REFUSE"), F.lit("refuse")).otherwise(F.lit("search"))
    sub = strip(p["sub_intent"])
    sub = F.when(~F.lower(sub).isin("null", "none", ""), sub)
    given = F.coalesce(p["rewritten_query"], F.lit(""))
    rewrite = F.when(intent != "search", F.lit("")).when(given != "", strip(given)).otherwise(raw_query)
    more = F.slice(F.filter(F.coalesce(p["expansion_queries"], F.array().cast("array<string>")), lambda x: F.coalesce(x != "", F.lit(False))), 1, 3)
    more = F.when(readable, F.transform(more, strip)).otherwise(F.array().cast("array<string>"))
    return F.struct(intent.alias("intent"), F.when(readable, sub).alias("sub_intent"), rewrite.alias("rewritten_query"), more.alias("expansion_queries"))


def rerank_reply(reply: Column) -> Column:
    """map(position to score in 0 .. 1), null if there is no list of scores. Unreadable entries are skipped, of a repeated id the last counts."""
    entries = F.from_json(reply, "scores array<struct<id:string,score:string>>")["scores"]
    read = F.transform(entries, lambda e: F.struct(F.expr("try_cast(1 as int)").alias("_"), e["id"].try_cast("int").alias("id"), e["score"].try_cast("double").alias("score")))
    good = F.filter(read, lambda e: e["id"].isNotNull() & e["score"].isNotNull())
    none = F.create_map().cast("map<int,double>")
    return F.aggregate(
        good, none, lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e["id"]), F.create_map(e["id"], F.greatest(F.lit(0.0), F.least(F.lit(1.0), e["score"]))))
    )


def entailment_reply(reply: Column) -> Column:
    """map(pair to whether it is supported); anything but true or "true" is not."""
    return F.transform_values(F.from_json(reply, "map<string,string>"), lambda k, v: F.coalesce(F.lower(F.trim(v)) == "true", F.lit(False)))


def structured_reply(reply: Column, fmt: Column) -> Column:
    """struct(answer, structured): the answer's text, and the payload of its shape as JSON ({"items": ..}, {"rows": ..}, or what stands under
    structured). A reply without an answer is the answer as it stands, without payload; a payload that is no object or list is none."""
    value = F.try_parse_json(reply)
    answer = F.when(F.substring(F.trim(F.to_json(F.try_variant_get(value, "$.answer", "variant"))), 1, 1) == '"', F.try_variant_get(value, "$.answer", "string"))

    def at(key: str) -> Column:
        text = F.to_json(F.try_variant_get(value, f"$.{key}", "variant"))
        return F.when(answer.isNotNull() & text.rlike(r"^[\[{]"), text)

    payload = (
        F.when(fmt == "list", F.concat(F.lit('{"items":'), at("items"), F.lit("}")))
        .when(fmt == "table", F.concat(F.lit('{"rows":'), at("rows"), F.lit("}")))
        .when(fmt == "json", at("structured"))
    )
    return F.struct(F.when(fmt == "prose", reply).otherwise(F.coalesce(answer, reply)).alias("answer"), payload.alias("structured"))


def policy_reply(reply: Column) -> Column:
    """SAFE, DISCLAIMER or REFUSE; whatever else is read as DISCLAIMER."""
    action = F.upper(strip(F.from_json(reply, "action string")["action"]))
    return F.when(action.isin("SAFE", "DISCLAIMER", "REFUSE"), action).otherwise(F.lit("DISCLAIMER"))


def output_format(explicit: Column, sub_intent: Column) -> Column:
    """The format asked for; for auto and null what the sub-intent suggests."""
    return F.coalesce(F.when(explicit != "auto", explicit), F.when(sub_intent == "list", F.lit("list")).when(sub_intent == "comparison", F.lit("table")).otherwise(F.lit("prose")))
