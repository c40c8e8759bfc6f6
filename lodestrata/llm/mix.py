"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.llm import tokens
from lodestrata.session import materialize

SEED = 17
#: A mix is cut into about so many blocks of equal tokens. More blocks follow the shares more closely; the seats are computed, not dealt out one by one.
BLOCKS = 100_000
#: Documents of a source are ordered within shards; a shard's running sum is what one task computes. A source has no more than MOST_SHARDS, so
#: that the plan, which the driver makes, has a fixed number of rows for each target; beyond that shards grow.
SHARD_TOKENS, MOST_SHARDS = 8_000_000, 4_096
#: Sources whose shard numbers go to the tasks as a table of known size.
KNOWN_SOURCES = 10_000


def sainte_lague(weights: dict, seats: int) -> dict:
    """Integer seats for each key, by highest quotients weight / (2 k + 1). Null, zero and negative weights get none; ties go to the smaller key.

    The quotients aren't dealt out one at a time: all seats with a quotient above a bisected level are given at once, the few at the level in order.
    """
    w = {k: float(v) for k, v in weights.items() if v is not None and v > 0}
    out = dict.fromkeys(weights, 0)
    if not w or seats <= 0:
        return out

    def given(level: float) -> dict:
        return {k: max(0, math.ceil((v / level - 1) / 2)) for k, v in w.items()}  # quotients v / (2 k + 1) > level

    low, high = min(w.values()) / (2 * seats + 1) / 2, max(w.values()) * 2
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        if sum(given(mid).values()) >= seats:
            low = mid
        else:
            high = mid
    out |= given(high)
    while (left := seats - sum(out.values())) > 0:
        for k in sorted(w, key=lambda k: (-(w[k] / (2 * out[k] + 1)), str(k)))[:left]:
            out[k] += 1
            if left > len(w):
                continue
            break
    return out


def token_counts(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, source, tokens of every document; null and empty texts have 0 tokens."""
    sizes = tokens.count(documents.select("doc_id", "text"), path)
    return sizes.join(documents.select("doc_id", "source").dropDuplicates(["doc_id"]), "doc_id").select("doc_id", "source", "tokens")


def quotas(sizes: DataFrame, targets: DataFrame, blocks: int = BLOCKS) -> list[dict]:
    """The plan of each (mix, source): wanted and possible tokens, seats. It aggregates to one row a source and mix before it reaches the driver.

    A mix's size is size_ratio of all tokens. A source that can't fill its seats within max_repeats gets what it can; its shortfall isn't given
    to others, whose shares of the mix's size stay as wanted. Rows without mix, source or positive share are left out; a repeated (mix, source)
    adds its shares and takes the larger max_repeats; a null max_repeats is 1, a null size_ratio 1.
    """
    total = sizes.agg(F.sum("tokens")).first()[0] or 0
    have = sizes.groupBy("source").agg(F.sum("tokens").alias("have"))
    rows = (
        targets.where("mix_name is not null and source is not null and target_share > 0")
        .groupBy("mix_name", "source")
        .agg(F.sum("target_share").alias("share"), F.coalesce(F.max("max_repeats"), F.lit(1)).alias("most"), F.coalesce(F.max("size_ratio"), F.lit(1.0)).alias("ratio"))
        .join(have, "source", "left")
        .orderBy("mix_name", "source")
        .collect()
    )
    out = []
    for mix in sorted({r.mix_name for r in rows}):
        own = [r for r in rows if r.mix_name == mix]
        size = max(r.ratio for r in own) * total
        unit = max(1.0, size / blocks)
        seats = sainte_lague({r.source: r.share for r in own}, round(size / unit))
        for r in own:
            have = r.have or 0
            wanted = seats[r.source] * unit
            out.append({"mix_name": mix, "source": r.source, "target_share": r.share, "max_repeats": int(r.most), "mix_tokens": float(size), "have": int(have), "wanted": min(wanted, float(have * max(0, r.most))), "unit": unit})
    return out


def mix(documents: DataFrame, targets: DataFrame, path: str | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(mix_name, doc_id, repeats), and (mix_name, source, target_share, reached_share, of_wanted, tokens, docs, max_repeats): the part of what
    the mix really holds, which sums to 1, and of what it was to hold.

    Each source's seats are apportioned again to shards of its documents by their tokens. Within a shard documents stand in seeded order, each
    covering its own stretch of the shard's tokens; a quota of q tokens is floor(q / size) whole rounds of the shard, and of the documents in
    one more round those whose middle lies within the rest. No document is repeated more than max_repeats times.
    """
    spark = documents.sparkSession
    sizes = materialize(token_counts(documents, path), "sizes")
    plan = quotas(sizes, targets)
    schema = "mix_name string, source string, target_share double, max_repeats int, mix_tokens double, have bigint, wanted double, unit double"
    wanted = spark.createDataFrame([tuple(r.values()) for r in plan], schema)
    used = spark.createDataFrame(sorted({(r["source"], min(MOST_SHARDS, max(1, math.ceil(r["have"] / SHARD_TOKENS)))) for r in plan}), "source string, shards int")
    docs = (
        sizes.where("tokens > 0").join(F.broadcast(used) if len(plan) <= KNOWN_SOURCES else used, "source")
        .withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("shards")).cast("int"))
        .withColumn("turn", F.xxhash64(F.lit(seed + 1), "doc_id"))
    )
    w = W.partitionBy("source", "shard").orderBy("turn", "doc_id")
    docs = docs.withColumn("middle", F.sum("tokens").over(w) - F.col("tokens") / 2)
    by_shard: dict[str, dict[int, int]] = {}
    for x in docs.groupBy("source", "shard").agg(F.sum("tokens").alias("size")).collect():  # MOST_SHARDS rows a source
        by_shard.setdefault(x.source, {})[x.shard] = x["size"]
    shard_plan = []
    for r in plan:
        own = by_shard.get(r["source"], {})
        seats = sainte_lague(own, round(r["wanted"] / r["unit"]))
        shard_plan += [(r["mix_name"], r["source"], k, int(size), min(seats[k] * r["unit"], float(size * r["max_repeats"])), r["max_repeats"]) for k, size in own.items()]
    quota = spark.createDataFrame(shard_plan, "mix_name string, source string, shard int, size bigint, quota double, max_repeats int")
    rounds = F.floor(F.col("quota") / F.col("size"))
    picked = docs.join(quota, ["source", "shard"]).withColumn(
        "repeats", F.least(F.col("max_repeats"), rounds + (F.col("middle") <= F.col("quota") - rounds * F.col("size")).cast("int")).cast("int")
    )
    picked = picked.where("repeats > 0").select("mix_name", "doc_id", "source", "tokens", "repeats")
    reached = picked.groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("docs"))
    reached = reached.withColumn("reached_share", F.col("tokens") / F.sum("tokens").over(W.partitionBy("mix_name")))
    report = (
        wanted.join(reached, ["mix_name", "source"], "left")
        .select("mix_name", "source", "target_share", F.coalesce("reached_share", F.lit(0.0)).alias("reached_share"), F.coalesce(F.col("tokens") / F.nullif(F.col("mix_tokens"), F.lit(0.0)), F.lit(0.0)).alias("of_wanted"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("docs", F.lit(0)).alias("docs"), "max_repeats")
    )
    return picked.select("mix_name", "doc_id", "repeats"), report
