"""Fusing ranked lists: reciprocal ranks, merging by the best score, reranking, thresholds and budgets."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(frame: DataFrame) -> DataFrame:
    """(id, score) with rank from 1 by score, ties by id. Ranked lists are candidate lists, of bounded size."""
    return frame.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def reciprocal_rank_fusion(lists: list[tuple[DataFrame, float]], rrf_k: int, k: int) -> DataFrame:
    """(id, score): the sum over the lists (id, rank), with weights, of weight / (rrf_k + rank)."""
    parts = [frame.select("id", (F.lit(float(w)) / (F.lit(rrf_k) + F.col("rank"))).alias("score")) for frame, w in lists]
    fused = reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.sum("score").alias("score"))
    return fused.orderBy(F.desc("score"), "id").limit(max(0, k))


def fuse(vectors: DataFrame, lexical: DataFrame, rrf_k: int, k: int, vector_weight: float = 1.0, lexical_weight: float = 1.0) -> DataFrame:
    """(id, score, mode, vector_rank, bm25_rank, bm25_score): fused ranks, or vectors alone where the lexical list is empty.

    The choice is made inside the plan, by a count of the lexical list.
    """
    v, w = ranked(vectors.select("id", "score")), ranked(lexical.select("id", "score"))
    both = v.select("id", F.col("score").alias("cosine"), F.col("rank").alias("vector_rank")).join(w.select("id", F.col("score").alias("bm25_score"), F.col("rank").alias("bm25_rank")), "id", "full")
    some = lexical.agg((F.count("*") > 0).alias("hybrid"))
    fused = F.coalesce(F.lit(float(vector_weight)) / (rrf_k + F.col("vector_rank")), F.lit(0.0)) + F.coalesce(F.lit(float(lexical_weight)) / (rrf_k + F.col("bm25_rank")), F.lit(0.0))
    out = both.crossJoin(F.broadcast(some))  # one row
    return (
        out.select("id", F.when(F.col("hybrid"), fused).otherwise(F.col("cosine")).alias("score"), F.when(F.col("hybrid"), "hybrid").otherwise("vector").alias("mode"), "vector_rank", "bm25_rank", "bm25_score")
        .orderBy(F.desc("score"), "id").limit(max(0, k))
    )


def merge_best(*groups: DataFrame) -> DataFrame:
    """(id, score): of each id the highest score of the groups."""
    return reduce(DataFrame.unionByName, [g.select("id", "score") for g in groups]).groupBy("id").agg(F.max("score").alias("score"))


def needs_expansion(best_score: float | None, threshold: float, enabled: bool = True) -> bool:
    """Whether a generated document should be searched for as well: the best score, or -1 without any, is below the threshold."""
    return enabled and (-1.0 if best_score is None else best_score) < threshold


def expansion_wanted(best: Column, threshold: float) -> Column:
    """The same for a column of best scores."""
    return F.coalesce(best, F.lit(-1.0)) < threshold


def status_counts(best: DataFrame, least: float) -> DataFrame:
    """One row for the k best (score): candidates, filtered (below the least score), best."""
    below = (F.col("score") < max(0.0, least)).cast("long")
    return best.agg(F.count("*").alias("candidates"), F.coalesce(F.sum(below), F.lit(0)).alias("filtered"), F.max("score").alias("best"))


def rerank(candidates: DataFrame, response: DataFrame) -> DataFrame:
    """Candidates (id, score, rank) in a reranker's order.

    response has (position, index, relevance), index counting candidates from 0. The first mention of a
    candidate counts, others and those out of range don't; candidates without mention follow in their own
    order and keep their score.
    """
    first = response.groupBy("index").agg(F.min("position").alias("position"), F.min_by("relevance", "position").alias("relevance"))
    joined = candidates.join(first, F.col("index") == F.col("rank") - 1, "left")
    order = Window.orderBy(F.col("position").asc_nulls_last(), "rank")
    ordered = joined.withColumn("final_rank", F.row_number().over(order))
    mentioned = F.row_number().over(Window.orderBy(F.col("position").asc_nulls_last()))
    return ordered.select(
        "id", F.coalesce("relevance", "score").alias("final_score"), "final_rank",
        F.when(F.col("position").isNotNull(), mentioned).alias("rerank_rank"), F.col("relevance").alias("rerank_score"),
    )


def top_then_threshold(frame: DataFrame, k: int, least: float) -> DataFrame:
    """The k best, and of those the ones of at least the score; nothing moves up for what is filtered out."""
    return frame.orderBy(F.desc("score"), "id").limit(max(0, k)).filter(F.col("score") >= max(0.0, least))


@dataclass(frozen=True)
class Budgets:
    ranking: int
    vector: int
    lexical: int


def budgets(k: int, hybrid: bool, rerank_multiplier: int | None = None, vector_multiplier: int = 8, lexical_multiplier: int = 8, plain_multiplier: int = 3, most_vectors: int = 512, most_reranked: int = 64) -> Budgets:
    """Sizes of the candidate lists for k results."""
    ranking = k if rerank_multiplier is None else max(k, min(k * rerank_multiplier, most_reranked))
    wide = ranking * (vector_multiplier if hybrid else plain_multiplier)
    return Budgets(ranking, max(ranking, min(wide, most_vectors)), ranking * lexical_multiplier if hybrid else 0)
