import random

import numpy as np
import pytest
from pyspark.ml.clustering import KMeansModel
from pyspark.sql import functions as F

from siftwatch.operators import scoring
from siftwatch.plans import pipeline
from siftwatch.sources import incidents, schemas, tables

from conftest import greedy, vector_table


def test_whole_run_and_what_it_saves(spark, tmp_path):
    rng = random.Random(7)
    words = ["ransomware", "router", "backdoor", "bank", "phishing", "cloud", "patch", "lsass", "c2", "mail", "vpn", "worm"]
    texts = [" ".join(rng.choices(words, k=30)) + f" case{i}" for i in range(36)]
    texts[20], texts[21] = texts[3], incidents.INCIDENTS[2][3]
    rows = [(i, str(i), f"n{i}", t, "vpn, mail", "2024-01-02", "", "feed", "a") for i, t in enumerate(texts)]
    threats = spark.createDataFrame(rows, schemas.THREAT)
    done = pipeline.run(threats, incidents.incidents(spark), k=3, restarts=2)
    scored = done.ranked().collect()
    assert 20 not in {r.row_id for r in scored}
    assert len(scored) == len(texts) - done.duplicates.removed.count()
    assert [r.risk_score for r in scored] == sorted((r.risk_score for r in scored), reverse=True)
    same = next(r for r in scored if r.row_id == 21)
    assert same.most_similar_idx == 2 and same.similarity_score > 0.999

    pipeline.save(done, str(tmp_path), "first")
    back = tables.scan_scored(spark, str(tmp_path / "threats_scored"))
    assert back.count() == len(scored)
    assert (3, 20) in {(r.original_idx, r.duplicate_idx) for r in spark.read.parquet(str(tmp_path / "duplicate_report")).collect()}
    assert sum(r.size for r in spark.read.parquet(str(tmp_path / "cluster_statistics")).collect()) == len(scored)
    assert len(KMeansModel.load(str(tmp_path / "cluster_model")).clusterCenters()) == 3
    metrics = {r.key: r.value for r in spark.read.parquet(str(tmp_path / "run_metrics")).collect()}
    assert metrics["raw_threat_count"] == 36 and metrics["deduplicated_threat_count"] == len(scored)
    # The run's own rows, scored as new ones by what was saved.
    again = {r.row_id: r for r in pipeline.score_with_saved(threats, incidents.incidents(spark), str(tmp_path)).collect()}
    assert set(again) == set(range(36))
    for r in scored:
        own = again[r.row_id]
        assert (own.cluster, own.most_similar_idx) == (r.cluster, r.most_similar_idx)
        assert own.risk_score == pytest.approx(r.risk_score)
    labels = spark.createDataFrame([(21, True)], "row_id bigint, is_critical boolean")
    rescored, found = pipeline.rescore_and_evaluate(spark, str(tmp_path), labels)
    assert rescored.count() == len(scored) and {r.total_critical for r in found.collect()} <= {1}
    new = scoring.rescore(back)
    assert new.where(F.col("risk_score") != F.col("risk_score_new")).isEmpty()


def test_run_on_the_vectors_of_an_encoder(spark):
    def encoder():
        return lambda texts: np.array([[t.count(c) for c in "abcdefgh"] for t in texts], float)

    texts = ["a" * (i % 5 + 1) + "bcdefgh"[i % 7] * (3 + i % 4) for i in range(40)] + ["", None]
    rows = [(i, str(i), f"n{i}", t, "", "2024-01-02", "", "feed", "a") for i, t in enumerate(texts)]
    threats = spark.createDataFrame(rows, schemas.THREAT)
    done = pipeline.run(threats, incidents.incidents(spark), k=3, restarts=2, **pipeline.encoded(threats, incidents.incidents(spark), encoder, 8))
    vectors = {i: np.array(encoder()([t or ""])[0]) for i, t in enumerate(texts)}
    unit = np.stack([v / (np.linalg.norm(v) + 1e-8) for v in vectors.values()])
    gone, _ = greedy(unit @ unit.T, 0.85)
    assert {r.row_id for r in done.scored.collect()} == set(range(42)) - gone and done.idf is None
    with pytest.raises(ValueError):
        pipeline.run(threats, incidents.incidents(spark), vectors=done.labelled)


def test_threats_without_a_given_vector_stay(spark):
    rows = [(i, str(i), f"n{i}", "x", "", "2024-01-02", "", "feed", "a") for i in range(12)]
    threats = spark.createDataFrame(rows, schemas.THREAT)
    given = vector_table(spark, np.eye(12)).where("row_id < 9").unionByName(spark.createDataFrame([(9, None)], "row_id bigint, embedding array<double>"))
    refs = vector_table(spark, np.eye(12)[:3]).select(F.col("row_id").cast("int").alias("idx"), "embedding")
    done = pipeline.run(threats, incidents.incidents(spark), k=3, restarts=2, vectors=given, incident_vectors=refs)
    scored = {r.row_id: r for r in done.scored.collect()}
    assert set(scored) == set(range(12)) and all(scored[i].similarity_score == 0 for i in (9, 10, 11))
