"""Ranking after retrieval: merge of the model's scores, the evidence gate, diversification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.config import DEFAULTS, Settings


def window_of(ranked: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The candidates that are ranked again."""
    return ranked.where(F.col("rank") <= settings.rerank_window)


def rerank(candidates: DataFrame, scores: DataFrame | None) -> DataFrame:
    """query_id, row, score, rank of candidates (query_id, row, score, rank) in the order of the model's scores.

    ``scores`` (query_id, scores: map of position from 0 to score) may lack positions, which then score 0, and whole questions (null or no row):
    those keep their order and scores. Equal scores keep their order.
    """
    if scores is None:
        return candidates
    both = candidates.join(scores, "query_id", "left")
    new = F.when(F.col("scores").isNull(), F.col("score")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_element_at("scores", (F.col("rank") - 1).cast("int")), F.lit(0.0)))))
    w = Window.partitionBy("query_id").orderBy(F.when(F.col("scores").isNull(), F.lit(0.0)).otherwise(-F.col("new")), "rank")
    return both.withColumn("new", new).withColumn("place", F.row_number().over(w)).select("query_id", "row", F.col("new").alias("score"), F.col("place").alias("rank"))


def gate(scores: Column, settings: Settings = DEFAULTS) -> Column:
    """struct(passed, top) of scores in descending order: enough at the top, or one candidate only, or a wide spread down to the middle."""
    first = F.coalesce(F.try_element_at(scores, F.lit(1)), F.lit(0.0))
    middle = F.try_element_at(scores, (F.floor(F.size(scores) / 2) + 1).cast("int"))
    spread = F.when(first > 0, (first - middle) / first).otherwise(F.lit(0.0))
    passed = (F.size(scores) > 0) & ((first >= settings.threshold_high) | (F.size(scores) == 1) | (spread >= settings.spread_min))
    return F.struct(F.coalesce(passed, F.lit(False)).alias("passed"), first.alias("top"))


def evidence(candidates: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """query_id, passed, top, weak (a hypothetical answer is tried), kept (candidates of more than 0, counted after the gate). The window bounds the list."""
    sorted_ = F.transform(F.array_sort(F.collect_list(F.struct(F.col("rank"), F.col("score")))), lambda x: x["score"])
    lists = window_of(candidates, settings).groupBy("query_id").agg(sorted_.alias("scores"))
    out = lists.select("query_id", gate(F.col("scores"), settings).alias("g"), F.size(F.filter("scores", lambda s: s > 0)).alias("positive"))
    return out.select("query_id", "g.passed", "g.top", (F.col("g.top") < settings.threshold_low).alias("weak"), F.when(F.col("g.passed"), F.col("positive")).otherwise(0).alias("kept"))


def mmr(candidates: Column, k: Column | int, weight: float = DEFAULTS.mmr_lambda) -> Column:
    """Positions (from 0) in the order they are picked from candidates, array<struct<rel: double, vec: array<double>>>.

    The most relevant first, then whoever has the most of weight x relevance - (1 - weight) x greatest dot product with those picked; ties go to
    the lower position. At least one is picked where there is any, never more than there are. The list is bounded by the window before it.
    """
    from lodestrata.functions.vectors import dot

    n = F.size(candidates)
    limit = F.least(F.greatest(F.lit(k) if isinstance(k, int) else k, F.lit(1)), n)
    places = F.sequence(F.lit(0), n - 1)
    rel = lambda i: F.element_at(candidates, (i + 1).cast("int"))["rel"]
    vec = lambda i: F.element_at(candidates, (i + 1).cast("int"))["vec"]
    best = lambda scored: -F.array_max(scored)["i"]
    seed = F.array(best(F.transform(places, lambda i: F.struct(rel(i).alias("s"), (-i).alias("i")))))

    def pick(chosen: Column, _: Column) -> Column:
        free = F.filter(places, lambda i: ~F.array_contains(chosen, i))
        scored = F.transform(free, lambda i: F.struct((weight * rel(i) - (1 - weight) * F.array_max(F.transform(chosen, lambda j: dot(vec(i), vec(j))))).alias("s"), (-i).alias("i")))
        return F.concat(chosen, F.array(best(scored)))

    rounds = F.when(limit >= 2, F.sequence(F.lit(2), limit)).otherwise(F.array().cast("array<int>"))
    return F.when(n > 0, F.aggregate(rounds, seed, pick)).otherwise(F.array().cast("array<int>"))


def diversify(candidates: DataFrame, vectors: DataFrame, top_k: DataFrame | int, settings: Settings = DEFAULTS) -> DataFrame:
    """query_id, row, score, rank: what is shown. Diversified where there are more candidates than ``top_k``, else in their order."""
    window = window_of(candidates, settings).join(vectors.select("row", F.col("embedding").cast("array<double>").alias("vec")), "row", "left")
    item = F.struct("rank", "row", F.col("score").alias("rel"), F.coalesce("vec", F.array().cast("array<double>")).alias("vec"))
    lists = window.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("c"))
    lists = lists.withColumn("k", F.lit(top_k)) if isinstance(top_k, int) else lists.join(top_k.select("query_id", F.col("top_k").alias("k")), "query_id")
    all_ = F.sequence(F.lit(0), F.least(F.size("c"), F.col("k")) - 1)
    picked = F.when(F.size("c") > F.col("k"), mmr(F.col("c"), F.col("k"), settings.mmr_lambda)).otherwise(all_)
    rows = lists.select("query_id", "c", F.posexplode(picked).alias("at", "i")).withColumn("x", F.element_at("c", F.col("i") + 1))
    return rows.select("query_id", "x.row", F.col("x.rel").alias("score"), (F.col("at") + 1).alias("rank"))
