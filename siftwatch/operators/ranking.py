"""Top-k reports, precision and recall at k, and the baselines they are compared with.

All of them read a scored table with ``row_id``, ``risk_score`` and, where a label is needed, a boolean column.
Ranks are numbered after a top-k limit, so no task ever sorts the whole table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from siftwatch.functions import text as T
from siftwatch.staging import stage

# Fixed values of the evaluation.
KS = [10, 20, 30, 50, 75, 100, 150, 200]
BASELINE_N = 50
SORTS = ("risk", "date", "keywords")


def _order(by: str) -> list[Column]:
    keys = {"risk": "risk_score", "date": "created_ts", "keywords": "num_keywords_matched"}
    if by not in keys:
        raise ValueError(f"sort must be one of {SORTS}")
    return [F.desc_nulls_last(keys[by]), F.asc("row_id")]


def top_n(df: DataFrame, n: int = 50, by: str = "risk") -> DataFrame:
    return df.orderBy(*_order(by)).limit(n)


def ranked_head(df: DataFrame, n: int, by: str = "risk") -> DataFrame:
    """The first ``n`` rows with their 1-based ``rank``."""
    order = W.orderBy(*_order(by))
    return top_n(df, n, by).withColumn("rank", F.row_number().over(order))


def top_report(df: DataFrame, n: int = 10, name_width: int = 55) -> DataFrame:
    """Rank, critical flag, scores and cut names of the highest risks; old scores appear if the table has them."""
    extra = [c for c in ("is_critical", "risk_score_old") if c in df.columns]
    return ranked_head(df, n).select(
        "rank", "row_id", *extra, "risk_score", T.head("name", name_width).alias("name")
    )


def component_profile(df: DataFrame, n: int = 50) -> DataFrame:
    return ranked_head(df, n).select("rank", "row_id", "similarity_score", "keyword_score", "novelty_score")


def precision_recall_at_k(df: DataFrame, ks: Sequence[int] = KS, label: str = "is_critical") -> DataFrame:
    """``(k, n_found, total_critical, precision, recall, f1)`` for every k up to the row count.

    Without critical rows the recall is NULL, and F1 is 0 unless precision plus recall is above 0.
    """
    flag = F.coalesce(F.col(label), F.lit(False)).cast("bigint")
    totals = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(flag), F.lit(0)).alias("total_critical"))
    head = ranked_head(df.select("row_id", "risk_score", flag.alias("hit")), max(ks))
    by_k = (
        head.select("hit", "rank", F.explode(F.array(*[F.lit(k) for k in sorted(set(ks))])).alias("k"))
        .where("rank <= k")
        .groupBy("k")
        .agg(F.sum("hit").alias("n_found"), F.count(F.lit(1)).alias("seen"))
        # A k beyond the table shows fewer rows than k.
        .where("seen = k")
    )
    total = totals.select("total_critical").scalar()
    p = F.col("n_found") / F.col("k")
    r = F.try_divide(F.col("n_found").cast("double"), F.col("total_critical").cast("double"))
    both = F.col("precision") + F.col("recall")
    return (
        by_k.withColumn("total_critical", total)
        .withColumn("precision", p.cast("double"))
        .withColumn("recall", r)
        .withColumn("f1", F.when(both > 0, 2.0 * F.col("precision") * F.col("recall") / both).otherwise(F.lit(0.0)))
        .select("k", "n_found", "total_critical", "precision", "recall", "f1")
    )


def _recall(sample: DataFrame, df: DataFrame, method: str, label: str) -> DataFrame:
    flag = F.coalesce(F.col(label), F.lit(False)).cast("bigint")
    total = df.agg(F.coalesce(F.sum(flag), F.lit(0)).alias("t")).scalar()
    return (
        sample.agg(F.coalesce(F.sum(flag), F.lit(0)).alias("n_found"))
        .withColumn("total_critical", total)
        .select(
            F.lit(method).alias("method"),
            "n_found",
            "total_critical",
            F.try_divide(F.col("n_found").cast("double"), F.col("total_critical").cast("double")).alias("recall"),
        )
    )


def random_sample(df: DataFrame, n: int = BASELINE_N, seed: int = 42, key: str = "id") -> DataFrame:
    """A sample of ``n`` rows that depends only on ``seed`` and the ids."""
    return df.orderBy(F.md5(F.concat(F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def baseline_random(df: DataFrame, n: int = BASELINE_N, seed: int = 42, label: str = "is_critical") -> DataFrame:
    return _recall(random_sample(df.select("id", label), n, seed), df, "random", label)


def baseline_recency(df: DataFrame, n: int = BASELINE_N, created: str = "created_date", label: str = "is_critical") -> DataFrame:
    """Recall of the ``n`` newest rows. ``created`` may be text, which is the order of time for uniform ISO dates."""
    newest = df.select("row_id", created, label).orderBy(F.desc_nulls_last(created), "row_id").limit(n)
    return _recall(newest, df, "recency", label)


def baseline_ranked(df: DataFrame, n: int = BASELINE_N, label: str = "is_critical") -> DataFrame:
    return _recall(top_n(df.select("row_id", "risk_score", label), n), df, "ranked", label)


def baseline_comparison(df: DataFrame, n: int = BASELINE_N, seed: int = 42, label: str = "is_critical") -> DataFrame:
    """The three recalls side by side and the gain over recency in percent, on every row. The input is read once, for
    a written projection of what the baselines order by."""
    df = stage(df.select("id", "row_id", "risk_score", "created_date", label))
    three = (
        baseline_random(df, n, seed, label)
        .unionByName(baseline_recency(df, n, label=label))
        .unionByName(baseline_ranked(df, n, label))
    )
    every = W.partitionBy(F.lit(1))
    recency = F.max(F.when(F.col("method") == "recency", F.col("recall"))).over(every)
    ranked = F.max(F.when(F.col("method") == "ranked", F.col("recall"))).over(every)
    return three.withColumn(
        "improvement_percent", (ranked - recency) / F.greatest(recency, F.lit(0.01)) * 100.0
    )
