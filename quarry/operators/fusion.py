"""Fusion of score lists, re-ranking, confidence and the whole retrieval path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import constants as K

DAY = 86_400.0


def minmax(scores: DataFrame) -> DataFrame:
    """Scores between 0 and 1; all 0 where they are alike (one hit, too)."""
    edge = scores.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    value = F.when(F.col("hi") == F.col("lo"), 0.0).otherwise((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return scores.crossJoin(F.broadcast(edge)).select("id", value.alias("score"))  # one row


def weighted(lists: list[tuple[DataFrame, float]]) -> DataFrame:
    """id, score: weighted sum of normalised lists over the union of their ids; one aggregation."""
    parts = [minmax(s).select("id", (F.col("score") * w).alias("score")) for s, w in lists]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("id").agg(F.sum("score").alias("score"))


def rrf(lists: list[DataFrame], pool: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of the first ``pool`` rows of each list."""
    out = None
    for s in lists:
        best = s.orderBy(F.desc("score"), "id").limit(pool)
        part = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).select("id", (1.0 / (constant + F.col("rank"))).alias("score"))  # ``pool`` rows
        out = part if out is None else out.unionByName(part)
    return out.groupBy("id").agg(F.sum("score").alias("score"))


def temporal_decay(ts: Column, now: float, half_life: float = DAY) -> Column:
    """Halves with each half-life of age; the future counts as now."""
    return F.pow(F.lit(2.0), -F.greatest(F.lit(now) - ts, F.lit(0.0)) / max(1.0, half_life))


def authority(channel: Column) -> Column:
    out = F.lit(K.OTHER_AUTHORITY)
    for name, value in K.SOURCE_AUTHORITY.items():
        out = F.when(channel == name, value).otherwise(out)
    return out


def rerank_score(ts: Column, channel: Column, activation: Column, now: float, half_life: float = DAY) -> Column:
    """0.3 x recency + 0.2 x authority + 0.5 x activation; relevance is no part of it."""
    return 0.3 * temporal_decay(ts, now, half_life) + 0.2 * authority(channel) + 0.5 * F.least(F.greatest(activation, F.lit(0.0)), F.lit(1.0))


def confident(scores: DataFrame, least: float = 0.1, gap: float = 0.5, most: int = 10) -> DataFrame:
    """Nothing if the best is under ``least``; else rows of ``least`` or more within ``gap`` of the best, ``most`` at most."""
    best = scores.agg(F.max("score").alias("best"))
    kept = scores.crossJoin(F.broadcast(best)).where((F.col("best") >= least) & (F.col("score") >= least) & (F.col("best") - F.col("score") <= gap))  # one row
    return kept.drop("best").orderBy(F.desc("score"), "id").limit(most)


def backend_search(memory: DataFrame, vector_scores: DataFrame, keyword_scores: DataFrame, k: int, now: float, half_life: float = DAY) -> DataFrame:
    """id, score of the k memories (id, ts, channel, activation, ...) that the whole path finds.

    max(3k, 10) candidates by weighted fusion times the root of their activation, re-ranked, then cut by confidence.
    """
    fused = weighted([(vector_scores, 0.7), (keyword_scores, 0.3)])
    budget = max(3 * k, 10)
    candidates = fused.orderBy(F.desc("score"), "id").limit(budget)
    active = candidates.join(memory, "id").withColumn("fused", F.col("score") * F.sqrt("activation"))
    ranked = active.withColumn("score", rerank_score(F.col("ts"), F.col("channel"), F.col("activation"), now, half_life))
    return confident(ranked).orderBy(F.desc("score"), "id").limit(k)


def hit_metrics(ranks: DataFrame) -> DataFrame:
    """Hit@1, @5, @10 and mean reciprocal rank of (query_id, rank of the first relevant row or null)."""
    hit = lambda k: F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"hit_{k}")
    return ranks.agg(hit(1), hit(5), hit(10), F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"), F.count("*").alias("n_queries"))
