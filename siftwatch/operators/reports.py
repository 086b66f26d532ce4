"""Filters, drill-down, counts and timelines over scored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from siftwatch.functions import text as T
from siftwatch.functions.bands import clean_score, risk_band
from siftwatch.operators.ranking import top_n
from siftwatch.operators.skew import lookup_join

HISTOGRAM_BINS = 30
PROXIMITY_LIMITS = (10, 50)


def facet_filter(
    df: DataFrame, bands: Sequence[str] | None = None, clusters: Sequence[int] | None = None
) -> DataFrame:
    """Rows in the chosen bands and clusters; ``None`` chooses all, an empty choice none."""
    if bands is not None:
        df = df.where(F.col("risk_category").isin(list(bands)))
    if clusters is not None:
        df = df.where(F.col("cluster").isin([int(c) for c in clusters]))
    return df


def date_range_filter(df: DataFrame, start: str, end: str, column: str = "created_ts") -> DataFrame:
    """Both ends are midnights and belong to the range, so of the last day only its first instant does."""
    return df.where(F.col(column).between(F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end))))


def text_search(df: DataFrame, pattern: str, columns: Sequence[str] = ("name", "description", "tags")) -> DataFrame:
    return df.where(T.search(pattern, *columns)) if pattern else df


def incident_enrich(df: DataFrame, incidents: DataFrame, idx: str = "most_similar_idx") -> DataFrame:
    """Adds the name of the row's incident; ``incidents`` is a written or literal table with ``idx`` and ``name``."""
    names = incidents.select(F.col("idx").alias(idx), F.col("name").alias("incident_name"))
    return lookup_join(df, names, idx, "left")


def drill_down(df: DataFrame, incidents: DataFrame) -> DataFrame:
    """What a reader sees of one row: cut texts, components, date and the incident it resembles."""
    return incident_enrich(df, incidents).select(
        "row_id",
        "risk_category",
        F.concat(T.head("name", 80), F.lit("...")).alias("title"),
        T.clipped("description", 500).alias("description"),
        T.head("tags", 100).alias("tags"),
        "matched_keywords",
        "risk_score",
        "similarity_score",
        "keyword_score",
        "novelty_score",
        "cluster",
        F.coalesce(F.date_format("created_ts", "yyyy-MM-dd"), F.lit("N/A")).alias("date"),
        "source",
        "incident_name",
    )


def band_counts(df: DataFrame, score: str = "risk_score") -> DataFrame:
    """All three bands with row count and share in percent. A missing score is in no band but counts as a row."""
    band = risk_band(score, missing=None)
    counted = df.select(band.alias("b")).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("b") == b).alias(b) for b in ("High", "Medium", "Low")],
    )
    return counted.select(
        "n", F.expr("stack(3, 'High', High, 'Medium', Medium, 'Low', Low) as (risk_category, n_rows)")
    ).select(
        "risk_category",
        "n_rows",
        (F.try_divide(F.col("n_rows").cast("double"), F.col("n").cast("double")) * 100.0).alias("percent"),
    )


def kpis(df: DataFrame) -> DataFrame:
    """One row: rows, high-risk rows and share, mean risk, clusters present, mean keyword count. No rows give NULLs."""
    counted = df.agg(
        F.count(F.lit(1)).alias("total_threats"),
        F.count_if(F.col("risk_category") == "High").alias("high_risk"),
        F.avg(clean_score("risk_score")).alias("avg_risk"),
        F.countDistinct("cluster").alias("n_clusters"),
        F.avg("num_keywords_matched").alias("avg_keywords"),
    )
    share = F.try_divide(F.col("high_risk").cast("double"), F.col("total_threats").cast("double")) * 100.0
    return counted.select(
        "total_threats", "high_risk", share.alias("high_risk_percent"), "avg_risk", "n_clusters", "avg_keywords"
    )


def score_histogram(df: DataFrame, bins: int = HISTOGRAM_BINS, score: str = "risk_score") -> DataFrame:
    """Rows per equal-width bin (1..bins between the smallest and largest score) and band."""
    scores = df.select(clean_score(score).alias("s"), "risk_category").where("s is not null")
    # One subquery for both ends, so that the table is read once for them.
    box = scores.agg(F.struct(F.min("s").alias("lo"), F.max("s").alias("hi")).alias("box")).scalar()
    lo, hi = box["lo"], box["hi"]
    at = F.floor(F.try_divide(F.col("s") - lo, hi - lo) * F.lit(float(bins)))
    # One distinct score has no width: everything is in the first bin. The largest score closes the last bin.
    number = F.least(F.coalesce(at, F.lit(0)), F.lit(bins - 1)) + 1
    return (
        scores.groupBy(number.cast("int").alias("bin"), "risk_category")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def cluster_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_rows")).orderBy("cluster")


def timeline_monthly(df: DataFrame, column: str = "created_ts") -> DataFrame:
    """Rows per calendar month; rows without a date are left out."""
    month = F.date_format(column, "yyyy-MM")
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(month.alias("month"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .orderBy("month")
    )


def score_proximity(df: DataFrame, n: int = 20) -> DataFrame:
    """``1 - |score difference|`` for all pairs among the top ``n`` (10 to 50) rows.

    The top rows come together as one array of at most 50 entries, which is unfolded against itself.
    """
    low, high = PROXIMITY_LIMITS
    if not low <= n <= high:
        raise ValueError(f"n must be from {low} to {high}")
    top = top_n(df.select("row_id", "risk_score", T.clipped("name", 40).alias("label")), n)
    held = top.agg(F.collect_list(F.struct("row_id", "label", "risk_score")).alias("rows"))
    a = held.select(F.explode("rows").alias("a"), "rows").select("a", F.explode("rows").alias("b"))
    return a.select(
        F.col("a.row_id").alias("row_a"),
        F.col("b.row_id").alias("row_b"),
        F.col("a.label").alias("label_a"),
        F.col("b.label").alias("label_b"),
        (F.lit(1.0) - F.abs(F.col("a.risk_score") - F.col("b.risk_score"))).alias("proximity"),
    )


def rescore_comparison(df: DataFrame) -> DataFrame:
    return df.agg(
        F.avg("risk_score_old").alias("old_mean"),
        F.avg("risk_score_new").alias("new_mean"),
        F.max("risk_score_old").alias("old_max"),
        F.max("risk_score_new").alias("new_max"),
    )


def long_metrics(one_row: DataFrame, run_id: str) -> DataFrame:
    """A one-row table of numbers as ``(run_id, key, value)``; missing values are left out."""
    cols: list[Column] = [F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in one_row.columns]
    return (
        one_row.select(F.explode(F.array(*cols)).alias("m"))
        .select(F.lit(run_id).alias("run_id"), "m.key", "m.value")
        .where("value is not null")
    )
