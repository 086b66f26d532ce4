"""Risk scores: similarity, keyword evidence and novelty, weighted and explained."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from siftwatch.functions import text as T
from siftwatch.operators import clusters, simjoin
from siftwatch.sources.keywords import CRITICAL


@dataclass(frozen=True)
class Weights:
    similarity: float = 0.33
    keyword: float = 0.33
    novelty: float = 0.34


DEFAULT_WEIGHTS = Weights()
RESCORE_WEIGHTS = Weights(0.50, 0.40, 0.10)


def add_keyword_score(df: DataFrame, keywords: Sequence[str] = CRITICAL, text: str = "description") -> DataFrame:
    """Adds ``matched_keywords`` (joined, in list order), ``num_keywords_matched`` and ``keyword_score``."""
    found = df.withColumn("_lower", F.lower(F.col(text))).withColumn(
        "_found", T.matched_keywords("_lower", keywords)
    )
    n = F.size("_found")
    return (
        found.withColumn("matched_keywords", F.array_join("_found", ", "))
        .withColumn("num_keywords_matched", n)
        .withColumn("keyword_score", T.keyword_points(n))
        .drop("_lower", "_found")
    )


def keyword_hits(df: DataFrame, keywords: Sequence[str], text: str = "description") -> DataFrame:
    """``(keyword, n_rows)`` for every keyword that occurs: how many rows contain it."""
    found = T.matched_keywords("_lower", keywords)
    return (
        df.select(F.lower(F.col(text)).alias("_lower"))
        .select(F.explode(F.array_distinct(found)).alias("keyword"))
        .groupBy("keyword")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def risk_score(weights: Weights = DEFAULT_WEIGHTS) -> Column:
    return (
        F.lit(weights.similarity) * F.col("similarity_score")
        + F.lit(weights.keyword) * F.col("keyword_score")
        + F.lit(weights.novelty) * F.col("novelty_score")
    )


def score_threats(
    df: DataFrame,
    incidents: DataFrame,
    centers: DataFrame,
    spread: DataFrame,
    keywords: Sequence[str] = CRITICAL,
    weights: Weights = DEFAULT_WEIGHTS,
    vector: str = "embedding",
    text: str = "description",
    ordered: bool = True,
) -> DataFrame:
    """Rows with vector and cluster get all score columns and are ranked: ``row_id``, cluster and the scores.

    ``incidents`` carries ``idx`` and vectors; ``centers`` and ``spread`` have one row per cluster. Keywords are found
    where the text is read; from there on only keys, scores and the vector move, and only keys and scores are sorted.
    Join the ranked rows to their texts by ``row_id`` for what is shown.
    """
    slim = add_keyword_score(df, keywords, text).select(
        "row_id", "cluster", "matched_keywords", "num_keywords_matched", "keyword_score", vector
    )
    scored = clusters.add_novelty(clusters.member_distances(slim, centers, vector), spread).drop("distance")
    scored = simjoin.nearest_reference(scored, incidents, vector).drop(vector)
    scored = scored.withColumn("risk_score", risk_score(weights))
    return rank_threats(scored) if ordered else scored


def rank_threats(df: DataFrame, score: str = "risk_score") -> DataFrame:
    """Highest score first, ties by row: a range-partitioned sort."""
    return df.orderBy(F.desc_nulls_last(score), "row_id")


def rescore(df: DataFrame, weights: Weights = RESCORE_WEIGHTS, ordered: bool = True) -> DataFrame:
    """New weights on the stored components; the old score is kept beside the new one."""
    new = (
        df.withColumn("risk_score_new", risk_score(weights))
        .withColumn("risk_score_old", F.col("risk_score"))
        .withColumn("risk_score", F.col("risk_score_new"))
    )
    return rank_threats(new) if ordered else new
