"""Exact median and distribution of a score column without gathering its values in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from siftwatch.functions.bands import clean_score
from siftwatch.staging import stage

BINS = 4096
# Once this few distinct values are left around the middle, they are ranked directly.
DIRECT_VALUES = 100_000


def exact_median(df: DataFrame, column: str = "risk_score") -> float | None:
    """The interpolated median.

    A count per equal-width bin narrows the range that holds the middle ranks, by a factor of ``BINS`` per pass,
    until few distinct values are left; their counts (not the rows) are then ranked. Every pass is one aggregate
    with a bounded result.
    """
    values = df.select(clean_score(F.col(column).cast("double")).alias("v")).where("v is not null")
    box = values.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if not box.n:
        return None
    lo, hi, below, inside = box.lo, box.hi, 0, box.n
    low_rank, high_rank = (box.n - 1) // 2, box.n // 2
    while True:
        within = values.where(F.col("v").between(lo, hi))
        width = (hi - lo) / BINS
        if inside <= DIRECT_VALUES or width == 0.0 or lo + width == lo:
            break
        bin_no = F.least(F.floor((F.col("v") - F.lit(lo)) / F.lit(width)), F.lit(BINS - 1))
        bins = (
            within.groupBy(bin_no.alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            .orderBy("bin")
            .collect()
        )
        upto, hit = below, []
        for b in bins:
            if upto + b.n > low_rank and upto <= high_rank:
                hit.append((upto, b))
            upto += b.n
        if len(hit) == 2:
            # The middle falls between two bins: it is their inner ends.
            return (hit[0][1].hi + hit[1][1].lo) / 2.0
        below, chosen = hit[0]
        lo, hi, inside = chosen.lo, chosen.hi, chosen.n
    running = F.sum("n").over(W.orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow))
    ranked = within.groupBy("v").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", running + below)
    middle = ranked.where((F.col("upto") > low_rank) & (F.col("upto") - F.col("n") <= high_rank))
    ends = middle.agg(F.min("v").alias("a"), F.max("v").alias("b")).first()
    return (ends.a + ends.b) / 2.0


def score_distribution(df: DataFrame, column: str = "risk_score", approximate: bool = False) -> DataFrame:
    """Mean, median, sample standard deviation, smallest and largest value, as one row.

    ``approximate`` takes the median from a sketch in the same pass instead of the exact narrowing passes, which
    work on the written score column alone.
    """
    scores = df.select(clean_score(F.col(column).cast("double")).alias("s"))
    if not approximate:
        scores = stage(scores)
    median = F.percentile_approx("s", 0.5) if approximate else F.lit(exact_median(scores, "s")).cast("double")
    stats = scores.agg(
        F.avg("s").alias("mean_score"),
        *([median.alias("median_score")] if approximate else []),
        F.stddev_samp("s").alias("std_score"),
        F.min("s").alias("min_score"),
        F.max("s").alias("max_score"),
    )
    if not approximate:
        stats = stats.withColumn("median_score", median)
    return stats.select("mean_score", "median_score", "std_score", "min_score", "max_score")
