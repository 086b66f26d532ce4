import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwatch.functions import text as T, vectors as VX
from siftwatch.functions.bands import is_critical, parse_timestamp, risk_band
from siftwatch.operators import clusters, ranking, reports, scoring, statistics
from siftwatch.sources import incidents, keywords
from siftwatch.staging import stage


def keyword_rows(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "row_id bigint, description string")
    return [
        (r.matched_keywords, r.num_keywords_matched, r.keyword_score)
        for r in scoring.add_keyword_score(df).orderBy("row_id").collect()
    ]


def test_keywords_are_substrings_in_list_order_and_count_once(spark):
    rows = keyword_rows(spark, "Open SOURCE tool", "spearphishing, spearphishing and Ransomware", "software supply chain attack", None, "")
    assert rows[0][:2] == ("rce", 1)
    assert rows[1][:2] == ("ransomware, phishing, spearphishing", 3)
    assert rows[2][:2] == ("supply chain attack, software supply chain", 2)
    assert rows[3] == ("", 0, 0.0) and rows[4] == ("", 0, 0.0)


def test_keyword_score_saturates_at_seven(spark):
    words = ["ransomware", "wiper", "setuid", "psexec", "lsass", "mimikatz", "backdoor", "bootkit"]
    scores = [r[2] for r in keyword_rows(spark, *[" ".join(words[:n]) for n in (6, 7, 8)])]
    assert scores == [pytest.approx(0.9), 1.0, 1.0]


def test_many_keywords_take_the_array_way_with_equal_results(spark):
    words = [f"key{i}x" for i in range(T.INLINE_KEYWORDS + 1)]
    df = spark.createDataFrame([(0, "KEY3x key150x"), (1, None)], "row_id bigint, description string")
    got = {r.row_id: r.matched_keywords for r in scoring.add_keyword_score(df, words).collect()}
    assert got == {0: "key3x, key150x", 1: ""}


def test_bands_are_strict_and_nan_is_low_but_uncounted(spark):
    df = spark.createDataFrame([(0.61,), (0.6,), (0.41,), (0.4,), (-0.1,), (math.nan,), (None,)], "risk_score double")
    assert [r[0] for r in df.select(risk_band()).collect()] == ["High", "Medium", "Medium", "Low", "Low", "Low", "Low"]
    counts = {r.risk_category: (r.n_rows, r.percent) for r in reports.band_counts(df).collect()}
    assert {k: v[0] for k, v in counts.items()} == {"High": 1, "Medium": 2, "Low": 2}
    assert counts["High"][1] == pytest.approx(100 / 7)


def test_critical_flag_limits(spark):
    df = spark.createDataFrame(
        [(0.55, 2), (0.56, 0), (0.0, 3), (math.nan, 0), (None, None)], "similarity_score double, num_keywords_matched int"
    )
    assert [r[0] for r in df.select(is_critical()).collect()] == [False, True, True, False, False]


def test_unreadable_dates_become_null(spark):
    df = spark.createDataFrame([("2024-01-02T03:04:05",), ("soon",), (None,)], "t string")
    got = [r[0] for r in df.select(parse_timestamp("t")).collect()]
    assert got[0].isoformat() == "2024-01-02T03:04:05" and got[1:] == [None, None]


def test_cosine_of_zero_vector_is_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([1.0, 1.0], [2.0, 2.0])], "u array<double>, v array<double>")
    got = [r[0] for r in df.select(VX.cosine("u", "v")).collect()]
    assert got[0] == 0.0 and got[1] == pytest.approx(1.0)
    unit = df.select(VX.l2_normalise("v").alias("n")).first().n
    assert np.allclose(unit, np.array([1, 2]) / math.sqrt(5))


def scored(spark, n=60):
    rows = [
        (i, str(i), f"name {i}", f"text {i}", "a, b", ((i * 37) % n) / n, 0.45, 0.5, i % 4, i % 7 == 0) for i in range(n)
    ]
    return spark.createDataFrame(
        rows,
        "row_id bigint, id string, name string, description string, tags string, similarity_score double, "
        "keyword_score double, novelty_score double, cluster int, is_critical boolean",
    ).withColumn("risk_score", scoring.risk_score())


def test_components_add_up_and_rescore_keeps_the_old_score(spark):
    df = scored(spark, 20)
    for r in df.collect():
        assert r.risk_score == pytest.approx(0.33 * r.similarity_score + 0.33 * r.keyword_score + 0.34 * r.novelty_score)
    new = scoring.rescore(df).collect()
    assert [r.risk_score for r in new] == sorted((r.risk_score for r in new), reverse=True)
    for r in new:
        assert r.risk_score == r.risk_score_new == pytest.approx(0.5 * r.similarity_score + 0.4 * r.keyword_score + 0.1 * r.novelty_score)
        assert r.risk_score_old == pytest.approx(0.33 * r.similarity_score + 0.33 * r.keyword_score + 0.34 * r.novelty_score)


def test_precision_recall_skips_large_k_and_found_never_falls(spark):
    df = scored(spark, 60)
    rows = ranking.precision_recall_at_k(df).orderBy("k").collect()
    assert [r.k for r in rows] == [10, 20, 30, 50]
    ranked = [r.is_critical for r in df.orderBy(F.desc("risk_score"), "row_id").collect()]
    for r in rows:
        found = sum(ranked[: r.k])
        assert (r.n_found, r.total_critical) == (found, sum(ranked))
        assert r.precision == pytest.approx(found / r.k) and r.recall == pytest.approx(found / sum(ranked))
    assert [r.n_found for r in rows] == sorted(r.n_found for r in rows)


def test_without_critical_rows_recall_is_null_and_f1_zero(spark):
    df = scored(spark, 30).withColumn("is_critical", F.lit(False))
    for r in ranking.precision_recall_at_k(df, [10]).collect():
        assert (r.precision, r.recall, r.f1) == (0.0, None, 0.0)
    assert ranking.baseline_random(df).first().recall is None


@pytest.mark.parametrize("direct", [100_000, 5])
def test_median_is_exact_in_both_ways(spark, monkeypatch, direct):
    monkeypatch.setattr(statistics, "DIRECT_VALUES", direct)
    rng = np.random.default_rng(0)
    for values in (rng.normal(size=301), np.repeat([1.0, 2.0, 4.0, 8.0], [50, 1, 1, 50]), np.repeat([1.0, 9.0], 40), rng.integers(0, 9, 200) / 3):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (math.nan,)], "risk_score double")
        assert statistics.exact_median(df) == pytest.approx(float(np.median(values)), abs=1e-12)
    assert statistics.exact_median(df.where("risk_score > 100 and not isnan(risk_score)")) is None


def test_empty_selection_gives_nulls(spark):
    df = scored(spark, 5).withColumns({"risk_category": risk_band(), "num_keywords_matched": F.lit(1)})
    row = reports.kpis(reports.facet_filter(df, bands=[])).first()
    assert (row.total_threats, row.high_risk_percent, row.avg_risk, row.n_clusters) == (0, None, None, 0)


def test_date_range_ends_at_midnight(spark):
    df = spark.sql("SELECT timestamp(t) created_ts FROM VALUES ('2024-01-01 00:00:00'), ('2024-01-03 00:00:00'), ('2024-01-03 00:00:01'), (null) AS v(t)")
    assert reports.date_range_filter(df, "2024-01-01", "2024-01-03").count() == 2


def test_search_is_a_case_insensitive_pattern_over_three_columns(spark):
    df = spark.createDataFrame(
        [("A", "x", None), ("b", None, "tagA"), ("b", "c", "d"), (None, "a.c", "")], "name string, description string, tags string"
    )
    assert reports.text_search(df, "a").count() == 3
    assert reports.text_search(df, r"A\.C").count() == 1
    assert reports.text_search(df, "").count() == 4


def test_histogram_of_one_value_and_proximity_limits(spark):
    df = scored(spark, 12).withColumn("risk_score", F.lit(0.5)).withColumn("risk_category", risk_band())
    assert [(r.bin, r.n_rows) for r in reports.score_histogram(df).collect()] == [(1, 12)]
    near = reports.score_proximity(scored(spark, 12), 10).collect()
    assert len(near) == 100 and all(r.proximity == 1.0 for r in near if r.row_a == r.row_b)
    with pytest.raises(ValueError):
        reports.score_proximity(df, 51)


def test_cluster_profile_lists_empty_clusters_and_breaks_tag_ties_by_first_seen(spark):
    rows = [
        (0, "n" * 50, "b,a", 0),
        (1, "short", " a ,b", 0),
        (2, "x", "c, b", 0),
        (3, "y", None, 2),
        (4, "z", "a", 0),
    ]
    df = spark.createDataFrame(rows, "row_id bigint, name string, tags string, cluster int")
    spread = spark.createDataFrame([(0, 0.5), (2, 0.0)], "cluster_id int, std_dev double")
    out = {r.cluster_id: r for r in clusters.cluster_profile(df, spread, 3).collect()}
    assert out[0].top_tags == "b, a, c" and out[0].percentage == 80.0
    assert out[0].sample_threats == " | ".join(["n" * 40 + "...", "short...", "x..."])
    assert (out[1].size, out[1].top_tags, out[1].sample_threats, out[1].std_dev) == (0, "N/A", "", 0.0)
    assert out[2].top_tags == "N/A" and out[2].sample_threats == "y..."
    unstripped = {r.tag for r in clusters.top_tags(df, strip_tags=False).collect()}
    assert {"a", " a "} <= unstripped
    sizes = clusters.cluster_size_summary(spark.createDataFrame([(0, 4), (1, 0), (2, 1)], "cluster_id int, size bigint")).first()
    assert (sizes.num_clusters, sizes.noise_points, sizes.max_cluster_size, sizes.min_cluster_size) == (2, 0, 4, 0)


def test_kmeans_separates_groups_and_novelty_is_limited(spark):
    rng = np.random.default_rng(1)
    m = np.concatenate([rng.normal(size=(40, 3)) * 0.05 + c for c in ([0, 0, 5], [5, 0, 0], [0, 5, 0])])
    df = stage(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "row_id bigint, embedding array<double>"))
    model = clusters.kmeans_fit(df, k=3, restarts=2)
    out = clusters.assign_clusters(df, clusters.model_centers(model))
    groups = {}
    for r in out.collect():
        groups.setdefault(r.row_id // 40, set()).add(r.cluster)
    assert sorted(len(g) for g in groups.values()) == [1, 1, 1] and len(set.union(*groups.values())) == 3
    assert clusters.inertia(out).first().inertia == pytest.approx(model.summary.trainingCost, rel=1e-6)
    with pytest.raises(ValueError):
        clusters.assign_clusters(df, None)


def test_novelty_rules(spark):
    d = spark.createDataFrame(
        [(0, 0, 2.0), (1, 0, 3.0), (2, 0, 5.0), (3, 1, 9.0), (4, 0, 1.0)], "row_id bigint, cluster int, distance double"
    )
    spread = spark.createDataFrame([(0, 1.0), (1, 1e-7)], "cluster_id int, std_dev double")
    got = {r.row_id: (r.novelty_z, r.novelty_score) for r in clusters.add_novelty(d, spread).collect()}
    assert got == {0: (0.0, 0.0), 1: (0.5, 0.5), 2: (1.5, 1.0), 3: (0.0, 0.0), 4: (-0.5, 0.0)}
    s = {r.cluster_id: (r.std_dev, r.size) for r in clusters.cluster_spread(d, 3).collect()}
    assert s[0][0] == pytest.approx(np.std([2, 3, 5, 1])) and s[1] == (0.0, 1) and s[2] == (0.0, 0)


def test_keyword_severity_first_list_wins(spark):
    df = spark.createDataFrame([("Defense Evasion",), ("macro",), ("apt28",), ("RYUK",), ("discovery",), ("tea",)], "k string")
    got = {r.k: r.severity for r in keywords.keyword_severity(df, "k", keywords.keyword_dim(spark)).collect()}
    assert got == {"Defense Evasion": "critical", "macro": "high", "apt28": "high", "RYUK": "high", "discovery": "medium", "tea": "low"}
    assert {c: len(w) for c, w in keywords.LISTS.items()} == {"critical": 60, "high": 8, "medium": 6, "group": 21, "family": 15}


def test_incidents(spark):
    table = incidents.incidents(spark)
    assert table.count() == 12
    assert incidents.incident_lookup(table, "CISA-2021-LOG4J").first().idx == 2
    assert incidents.incident_lookup(table, "none").isEmpty()
    assert {r.severity for r in table.collect()} == {"critical", "high"}
