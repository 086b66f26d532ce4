"""The whole triage run: texts to vectors, duplicates out, clusters, scores, ranked result and run metrics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import KMeansModel
from pyspark.sql import DataFrame, functions as F

from siftwatch.operators import clusters, dedup, ranking, reports, scoring, simjoin, statistics, textjoin, vectorize
from siftwatch.sources import tables
from siftwatch.sources.keywords import CRITICAL
from siftwatch.staging import stage


@dataclass(frozen=True)
class Run:
    """Tables of one run, all of them written. ``scored`` has the threats' columns and is in no order."""

    threats: DataFrame
    duplicates: dedup.Duplicates
    idf: vectorize.Idf | None  # none where vectors were given
    labelled: DataFrame  # row_id, embedding, cluster, distance
    spread: DataFrame
    model: KMeansModel
    scored: DataFrame

    def ranked(self) -> DataFrame:
        return scoring.rank_threats(self.scored)

    def duplicate_report(self) -> DataFrame:
        return dedup.duplicate_report(self.duplicates.pairs, self.threats)

    def cluster_stats(self) -> DataFrame:
        kept = self.threats.join(self.labelled.select("row_id", "cluster"), "row_id")
        return clusters.cluster_profile(kept, self.spread, self.model.summary.k)

    def metrics(self, run_id: str) -> DataFrame:
        return run_metrics(
            run_id,
            dedup.dedup_summary(self.threats, self.duplicates.removed),
            clusters.cluster_size_summary(self.spread),
            self.scored,
        )


def prepare_incidents(incidents: DataFrame, idf: vectorize.Idf, text: str = "description") -> DataFrame:
    """Incidents ``(idx, text)`` as vectors in the space of the corpus."""
    rows = incidents.select(F.col("idx").cast("bigint").alias("row_id"), text)
    vectors = vectorize.dense_vectors(vectorize.term_counts(rows, text), idf)
    return vectors.select(F.col("row_id").cast("int").alias("idx"), "embedding")


def run(
    threats: DataFrame,
    incidents: DataFrame,
    k: int = clusters.K,
    threshold: float = dedup.THRESHOLD,
    keywords: Sequence[str] = CRITICAL,
    weights: scoring.Weights = scoring.DEFAULT_WEIGHTS,
    restarts: int = clusters.RESTARTS,
    max_iter: int = clusters.MAX_ITER,
    text: str = "description",
    vectors: DataFrame | None = None,
    incident_vectors: DataFrame | None = None,
) -> Run:
    """``threats`` is keyed by ``row_id``; ``incidents`` has ``idx`` and the text column.

    Without ``vectors`` the texts are tokenised once. Duplicates are found in the wide sparse space, clusters and
    similarities use the dense vectors folded from it. With ``vectors`` (row_id, embedding) and ``incident_vectors``
    (idx, embedding), such as a user's encoder gives (``encoded``), all three use those; a threat without one gets zeros.
    """
    idf = None
    if vectors is not None:
        if incident_vectors is None:
            raise ValueError("given vectors need incident vectors of the same encoder")
        some = vectors.select("embedding").unionByName(incident_vectors.select("embedding")).where("embedding IS NOT NULL").first()
        zeros = F.lit([0.0] * len(some[0]) if some else []).cast(vectors.schema["embedding"].dataType)
        given = threats.select("row_id").join(vectors.select("row_id", "embedding"), "row_id", "left")
        given = stage(given.withColumn("embedding", F.coalesce("embedding", zeros)))
        duplicates = dedup.find_duplicates(given, threshold=threshold)
        vectors, references = stage(given.join(duplicates.removed, "row_id", "left_anti")), incident_vectors
    else:
        terms = stage(vectorize.term_counts(threats, text))
        duplicates = textjoin.find_duplicates(threats, text, threshold)
        idf = vectorize.fit_idf(terms)
        kept = terms.join(duplicates.removed, "row_id", "left_anti")
        vectors = stage(vectorize.dense_vectors(kept, idf))
        references = stage(prepare_incidents(incidents, idf, text))
    model = clusters.kmeans_fit(vectors, k, restarts=restarts, max_iter=max_iter)
    labelled = stage(clusters.assign_clusters(vectors, clusters.model_centers(model)))
    spread = stage(clusters.cluster_spread(labelled, k))
    slim = clusters.add_novelty(labelled, spread).select("row_id", "cluster", "novelty_z", "novelty_score", "embedding")
    parts = simjoin.nearest_reference(slim, references).drop("embedding")
    # The texts move once, to their scores, and are written there; reports and rankings read that table.
    scored = stage(
        scoring.add_keyword_score(threats, keywords, text)
        .join(parts, "row_id")
        .withColumn("risk_score", scoring.risk_score(weights))
    )
    return Run(threats, duplicates, idf, labelled, spread, model, scored)


def encoded(threats: DataFrame, incidents: DataFrame, encoder, dim: int, text: str = "description") -> dict[str, DataFrame]:
    """The vectors of both tables by a user's encoder, as arguments of ``run``."""
    rows = vectorize.embed_with(threats, encoder, dim, text)
    refs = vectorize.embed_with(incidents.select(F.col("idx").cast("bigint").alias("row_id"), text), encoder, dim, text)
    return {"vectors": stage(rows), "incident_vectors": stage(refs.select(F.col("row_id").cast("int").alias("idx"), "embedding"))}


def save(done: Run, folder: str, run_id: str) -> None:
    """Everything a run leaves behind: ranked rows, reports, vectors with labels, the cluster model and the metrics.

    The metrics are appended to those of earlier runs, the rest replaces the last run's.
    """
    tables.write_scored(done.scored, f"{folder}/threats_scored")
    tables.write_duplicate_report(done.duplicate_report(), f"{folder}/duplicate_report")
    tables.write_cluster_stats(done.cluster_stats(), f"{folder}/cluster_statistics")
    tables.write_vectors(done.labelled, f"{folder}/vectors")
    done.model.write().overwrite().save(f"{folder}/cluster_model")
    tables.append_metrics(done.metrics(run_id), f"{folder}/run_metrics")
    spark = done.scored.sparkSession
    centers = list(enumerate(clusters.model_centers(done.model)))
    save_space(done.idf, spark.createDataFrame(centers, "cluster_id int, center array<double>"), done.spread, folder)


def save_space(idf: vectorize.Idf | None, centers: DataFrame, spread: DataFrame, folder: str) -> None:
    """What new rows need to be scored like a run's own: document frequencies, cluster centers and their spread."""
    spark = centers.sparkSession
    if idf is not None:
        rows = [(-1, idf.n_rows), *enumerate(idf.df.tolist())]
        tables.write(spark.createDataFrame(rows, "bucket int, n bigint"), f"{folder}/document_frequencies")
    tables.write(centers.select("cluster_id", "center"), f"{folder}/cluster_centers")
    tables.write(spread.select("cluster_id", "std_dev"), f"{folder}/cluster_spread")


def score_with_saved(
    threats: DataFrame,
    incidents: DataFrame,
    folder: str,
    keywords: Sequence[str] = CRITICAL,
    weights: scoring.Weights = scoring.DEFAULT_WEIGHTS,
    text: str = "description",
) -> DataFrame:
    """New ``threats`` in the space that ``save`` or ``save_space`` left in ``folder``, scored and ranked.

    Rows without a ``cluster`` column go to the nearest center. Texts, not vectors, are what is new here: a run on
    given vectors has no document frequencies to score with.
    """
    spark = threats.sparkSession
    counts = {r.bucket: r.n for r in spark.read.parquet(f"{folder}/document_frequencies").collect()}  # one per bucket
    n_rows = counts.pop(-1)
    idf = vectorize.Idf(len(counts), n_rows, np.array([counts[b] for b in range(len(counts))]))
    centers, spread = (spark.read.parquet(f"{folder}/{t}") for t in ("cluster_centers", "cluster_spread"))
    vectors = vectorize.dense_vectors(vectorize.term_counts(threats, text), idf)
    if "cluster" not in threats.columns:
        means = [r.center for r in centers.orderBy("cluster_id").collect()]  # one per cluster
        vectors = clusters.assign_clusters(vectors, means).drop("distance")
    rows = threats.select("row_id", text, *(["cluster"] if "cluster" in threats.columns else [])).join(stage(vectors), "row_id")
    return scoring.score_threats(rows, stage(prepare_incidents(incidents, idf, text)), centers, spread, keywords, weights, text=text)


def rescore_and_evaluate(spark, folder: str, labels: DataFrame, weights: scoring.Weights = scoring.RESCORE_WEIGHTS) -> tuple[DataFrame, DataFrame]:
    """A saved run's scored table under new weights, and precision and recall at K of its new order. ``labels`` marks
    the critical rows: ``(row_id, is_critical)``."""
    scored = spark.read.parquet(f"{folder}/threats_scored")
    new = stage(scoring.rescore(scored, weights, ordered=False))
    marked = new.drop("is_critical").join(labels.select("row_id", "is_critical"), "row_id", "left")
    return new, ranking.precision_recall_at_k(marked.withColumn("is_critical", F.coalesce("is_critical", F.lit(False))))


def run_metrics(run_id: str, summary: DataFrame, sizes: DataFrame, scored: DataFrame) -> DataFrame:
    """One run's numbers as ``(run_id, key, value)``."""
    bands = reports.band_counts(scored).select(
        F.lit(run_id).alias("run_id"),
        F.concat(F.lower("risk_category"), F.lit("_risk_threats")).alias("key"),
        F.col("n_rows").cast("double").alias("value"),
    )
    parts = [
        summary.select(
            F.col("original").alias("raw_threat_count"),
            F.col("unique_rows").alias("deduplicated_threat_count"),
            F.col("removed").alias("duplicates_removed"),
            F.col("rate_percent").alias("deduplication_rate_percent"),
        ),
        sizes,
        statistics.score_distribution(scored).select(
            *[F.col(f"{s}_score").alias(f"{s}_risk_score") for s in ("mean", "median", "std", "min", "max")]
        ),
    ]
    out = bands
    for part in parts:
        out = out.unionByName(reports.long_metrics(part, run_id))
    return out
