"""The registered queries: one per operator, each over its whole tables. Numbers are rounded to 6 digits."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftwatch.functions import text as T, vectors as VX
from siftwatch.functions.bands import is_critical, parse_timestamp, risk_band
from siftwatch.operators import (
    clusters,
    dedup,
    ranking,
    reports,
    scoring,
    simjoin,
    statistics,
    textjoin,
    vectorize,
)
from siftwatch.plans import fixtures as fx, pipeline
from siftwatch.sources import incidents as inc, keywords as kw, pulses, tables
from siftwatch.staging import stage, stage_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(c) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in cols})


# --- sources ---------------------------------------------------------------------------------------------------

THREAT_FILE = "row_id bigint, id string, name string, description string, tags string, created_date string"
SCORED_FILE = (
    "row_id bigint, id string, name string, description string, tags string, created_date string, risk_score double, similarity_score double, "
    "keyword_score double, novelty_score double, matched_keywords string, num_keywords_matched int, cluster int"
)


@query
def scan_threats(spark, sf):
    path = stage_path(spark)
    columns = [f.split()[0] for f in THREAT_FILE.split(", ")]
    tables.write_threats(fx.threats(spark, sf).select(*columns), path, "csv")
    return tables.scan_threats(spark, path, "csv", THREAT_FILE)


@query
def scan_scored(spark, sf):
    path = stage_path(spark)
    tables.write_scored(fx.scored(spark, sf).select(*[f.split()[0] for f in SCORED_FILE.split(", ")]), path)
    scored = tables.scan_scored(spark, path, schema=SCORED_FILE)
    return rounded(scored, "risk_score", "similarity_score", "keyword_score", "novelty_score")


@query
def scan_cluster_stats(spark, sf):
    path = stage_path(spark)
    tables.write_cluster_stats(_profile(spark, sf), path, "csv")
    return rounded(tables.scan_cluster_stats(spark, path, "csv"), "percentage", "std_dev")


@query
def flatten_pulse_pages(spark, sf):
    """Pages landed as JSON files, one of them empty, and read back."""
    flat = pulses.flatten_pulse_pages(pulses.read_pulse_pages(spark, fx.land_pages(spark, sf, stage_path(spark))))
    return flat.select(
        "page",
        F.col("pos").cast("bigint").alias("pos"),
        "id",
        "description",
        F.array_join("tags", "|").alias("tags"),
        F.col("author.username").alias("username"),
    )


@query
def normalise_pulses(spark, sf):
    flat = pulses.flatten_pulse_pages(fx.pulse_pages(spark, sf))
    return pulses.normalise_pulses(flat).drop("page", "pos")


@query
def quality_filter(spark, sf):
    flat = pulses.normalise_pulses(pulses.flatten_pulse_pages(fx.pulse_pages(spark, sf)))
    return pulses.quality_filter(flat).drop("page", "pos")


@query
def collection_summary(spark, sf):
    flat = pulses.normalise_pulses(pulses.flatten_pulse_pages(fx.pulse_pages(spark, sf)))
    return rounded(pulses.collection_summary(flat), "filter_rate")


@query
def incidents(spark, sf):
    return fx.incidents(spark, sf)


@query
def incident_lookup(spark, sf):
    return inc.incident_lookup(fx.incidents(spark, sf), "INC-7")


@query
def incident_texts(spark, sf):
    return inc.incident_texts(fx.incidents(spark, sf))


@query
def incident_text_length(spark, sf):
    return rounded(inc.incident_text_length(fx.incidents(spark, sf)), "mean_description_length")


@query
def keyword_dim(spark, sf):
    """Every entry of the built-in lists with the number of documents that contain it."""
    dim = kw.keyword_dim(spark)
    words = [w for words in kw.LISTS.values() for w in words]
    hits = scoring.keyword_hits(fx.threats(spark, sf), words)
    return dim.join(hits, "keyword", "left").select(
        "pos", "category", "keyword", "severity", F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows")
    )


@query
def keyword_list_counts(spark, sf):
    """Sizes of the fixture lists, and how many of their entries occur in the documents."""
    dim = kw.keyword_dim(spark, fx.LISTS)
    words = sorted({w for words in fx.LISTS.values() for w in words})
    hits = scoring.keyword_hits(fx.threats(spark, sf), words)
    found = dim.join(hits, "keyword").groupBy("category").agg(F.count(F.lit(1)).alias("n_found"))
    return (
        kw.keyword_list_counts(dim)
        .join(found, "category", "left")
        .select("category", "n_keywords", F.coalesce("n_found", F.lit(0)).cast("bigint").alias("n_found"))
    )


@query
def keyword_severity(spark, sf):
    """Severity of every word of every document text, counted."""
    words = fx.threats(spark, sf).select(F.explode(F.split("description", r"[^\p{L}\p{N}_]+")).alias("word"))
    counted = words.where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n_rows"))
    return kw.keyword_severity(counted, "word", kw.keyword_dim(spark, fx.LISTS))


@query
def run_metrics(spark, sf):
    scored = fx.scored(spark, sf)
    removed = _text_duplicates(spark, sf).removed
    sizes = clusters.cluster_spread(scored.withColumn("distance", F.lit(0.0)), fx.N_CLUSTERS)
    return rounded(
        pipeline.run_metrics("run", dedup.dedup_summary(scored, removed), clusters.cluster_size_summary(sizes), scored),
        "value",
    )


# --- projections and filters -----------------------------------------------------------------------------------


@query
def risk_band_of_scores(spark, sf):
    s = fx.scored(spark, sf)
    return s.select("row_id", risk_band("risk_score").alias("risk_category"))


QUERIES["risk_band"] = QUERIES.pop("risk_band_of_scores")


@query
def critical_flag(spark, sf):
    return fx.scored(spark, sf).select("row_id", is_critical(sim_threshold=0.55).alias("is_critical"))


@query
def parse_dates(spark, sf):
    """Event times as text, every fifth kind of text unreadable."""
    e = fx.table(spark, sf, "events")
    text = F.when(F.col("event_type") == "error", F.lit("not a date")).otherwise(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    )
    return e.select("event_id", parse_timestamp(text).alias("created_ts"))


@query
def facet_filter(spark, sf):
    return reports.facet_filter(fx.scored(spark, sf), ["High", "Medium"], [0, 1, 2, 3, 5, 8, 13]).select(
        "row_id", "risk_category", "cluster"
    )


@query
def date_range_filter(spark, sf):
    e = fx.table(spark, sf, "events")
    return reports.date_range_filter(e, "2024-01-05", "2024-01-11", "ts").select("event_id", "ts")


@query
def text_search(spark, sf):
    return reports.text_search(fx.scored(spark, sf), "apache|nicht +für|LICENSE").select("row_id", "name", "tags")


@query
def drill_down(spark, sf):
    shown = reports.drill_down(fx.scored(spark, sf), fx.incidents(spark, sf))
    return rounded(shown, "risk_score", "similarity_score", "keyword_score", "novelty_score")


@query
def incident_enrich(spark, sf):
    return reports.incident_enrich(fx.scored(spark, sf), fx.incidents(spark, sf)).select(
        "row_id", "most_similar_idx", "incident_name"
    )


# --- vectors ---------------------------------------------------------------------------------------------------


def _checksum(vector: str) -> list[Column]:
    """Numbers that pin a vector down: its sum, squared norm and a position-weighted sum."""
    v = VX.as_double(vector)
    add = lambda acc, x: acc + x
    return [
        r6(F.aggregate(v, F.lit(0.0), add)).alias("total"),
        r6(VX.dot(v, v)).alias("square"),
        r6(F.aggregate(F.transform(v, lambda x, i: x * (i + 1)), F.lit(0.0), add)).alias("weighted"),
    ]


@query
def embed_text(spark, sf):
    return vectorize.embed_text(fx.threats(spark, sf)).select("row_id", *_checksum("embedding"))


@query
def embed_encoder(spark, sf):
    """A user-supplied encoder: here the counts of five vowels per text."""

    def load():
        return lambda texts: np.array([[t.count(v) for v in "aeiou"] for t in texts], dtype=np.float64)

    rows = fx.threats(spark, sf)
    return vectorize.embed_with(rows, load, 5).select("row_id", *_checksum("embedding"))


@query
def blank_zero_vector(spark, sf):
    """Vectors of the rows whose quality is unknown stand for blank texts."""
    v = fx.vectors(spark, sf).join(
        fx.table(spark, sf, "labels").select(F.col("doc_id").alias("row_id"), "quality"), "row_id", "left"
    )
    text = F.when(F.col("quality").isNotNull(), F.lit("known")).otherwise(F.lit(" \t\n"))
    return v.select("row_id", VX.blank_to_zero(text, "embedding", 64).alias("v")).select("row_id", *_checksum("v"))


@query
def l2_normalise(spark, sf):
    scaled = F.transform(VX.as_double("embedding"), lambda x: x * (F.col("cluster") + 2))
    v = fx.vectors(spark, sf).select("row_id", scaled.alias("v"))
    return v.select("row_id", VX.l2_normalise("v").alias("u")).select("row_id", *_checksum("u"))


@query
def cosine_pair(spark, sf):
    """Every vector with the next one."""
    v = fx.vectors(spark, sf).select("row_id", "embedding")
    following = v.select((F.col("row_id") - 1).alias("row_id"), F.col("embedding").alias("other"))
    return v.join(following, "row_id").select("row_id", r6(VX.cosine("embedding", "other")).alias("sim"))


def _units(spark, sf):
    return stage(simjoin.unit_vectors(fx.vectors(spark, sf)))


@query
def similarity_pairs(spark, sf):
    """The whole matrix, every row with every row."""
    return rounded(simjoin.similarity_pairs(_units(spark, sf)), "sim")


@query
def near_dup_pairs(spark, sf):
    return rounded(simjoin.pairs_above(_units(spark, sf), fx.VECTOR_THRESHOLD), "sim")


@query
def text_near_dup_pairs(spark, sf):
    units = textjoin.units_of(fx.threats(spark, sf), "description", dedup.THRESHOLD)
    return rounded(textjoin.pairs_above(units, dedup.THRESHOLD), "sim")


@query
def greedy_dedup(spark, sf):
    """Row ids that survive among the dense vectors."""
    v = fx.vectors(spark, sf)
    found = dedup.find_duplicates(v, threshold=fx.VECTOR_THRESHOLD)
    return dedup.clean(v.select("row_id"), found.removed)


def _text_duplicates(spark, sf):
    return textjoin.find_duplicates(fx.threats(spark, sf))


@query
def clean_threats(spark, sf):
    t = fx.threats(spark, sf)
    return dedup.clean(t, _text_duplicates(spark, sf).removed, renumber_rows=True).select("row_id", "id", "name")


@query
def duplicate_report(spark, sf):
    t = fx.threats(spark, sf)
    return rounded(dedup.duplicate_report(_text_duplicates(spark, sf).pairs, t), "similarity")


@query
def duplicate_samples(spark, sf):
    t = fx.threats(spark, sf)
    report = dedup.duplicate_report(_text_duplicates(spark, sf).pairs, t, ordered=False)
    return rounded(dedup.duplicate_samples(report), "similarity")


@query
def dedup_summary(spark, sf):
    v = fx.vectors(spark, sf)
    found = dedup.find_duplicates(v, threshold=fx.VECTOR_THRESHOLD)
    return rounded(dedup.dedup_summary(v, found.removed), "rate_percent")


@query
def kmeans_fit(spark, sf):
    """Best-of-ten fit on all vectors, each behind ten times its label in one-hot form: the best partition is then
    that of the labels. Clusters are named by their first row, as the solver's numbers mean nothing."""
    v = fx.vectors(spark, sf)
    hot = F.array(*(F.when(F.col("cluster") == i, 10.0).otherwise(0.0) for i in range(clusters.K)))
    points = stage(v.select("row_id", F.concat(hot, F.col("embedding").cast("array<double>")).alias("embedding")))
    model = clusters.kmeans_fit(points, k=clusters.K)
    labelled = stage(clusters.assign_clusters(points, clusters.model_centers(model)).drop("embedding"))
    named = labelled.groupBy("cluster").agg(
        F.min("row_id").alias("first_row"),
        F.count(F.lit(1)).alias("size"),
        r6(F.sum(F.col("distance") * F.col("distance"))).alias("inertia"),
    )
    return labelled.join(F.broadcast(named), "cluster").select("row_id", "first_row", "size", "inertia")


def _centers(spark, sf):
    return stage(clusters.cluster_centers(fx.vectors(spark, sf)))


@query
def cluster_centers(spark, sf):
    return _centers(spark, sf).select("cluster_id", "size", *_checksum("center"))


@query
def assign_clusters(spark, sf):
    """Nearest of the ten label means for every vector."""
    centers = [r.center for r in _centers(spark, sf).orderBy("cluster_id").collect()]
    given = clusters.assign_clusters(fx.vectors(spark, sf).drop("cluster"), centers)
    return given.select("row_id", "cluster", r6("distance").alias("distance"))


def _distances(spark, sf):
    return clusters.member_distances(fx.vectors(spark, sf), _centers(spark, sf))


@query
def cluster_spread(spark, sf):
    return rounded(clusters.cluster_spread(_distances(spark, sf), 12), "std_dev")


@query
def inertia(spark, sf):
    return rounded(clusters.inertia(_distances(spark, sf)), "inertia")


@query
def novelty(spark, sf):
    d = _distances(spark, sf)
    spread = stage(clusters.cluster_spread(d))
    # Every tenth row has lost its cluster by now, and stays.
    known = d.withColumn("cluster", F.when(F.col("row_id") % 10 != 3, F.col("cluster")))
    return rounded(
        clusters.add_novelty(known, spread).select("row_id", "cluster", "novelty_z", "novelty_score"),
        "novelty_z",
        "novelty_score",
    )


# --- scoring ---------------------------------------------------------------------------------------------------


def _vectorised(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Threats, their dense vectors and the incident vectors in the same space."""
    t = fx.threats(spark, sf)
    terms = stage(vectorize.term_counts(t))
    idf = vectorize.fit_idf(terms)
    vectors = stage(vectorize.dense_vectors(terms, idf))
    return t, vectors, stage(pipeline.prepare_incidents(fx.incidents(spark, sf), idf))


@query
def nearest_incident(spark, sf):
    _, vectors, refs = _vectorised(spark, sf)
    return rounded(simjoin.nearest_reference(vectors, refs).drop("embedding"), "similarity_score")


@query
def similarity_score(spark, sf):
    """The score alone, with the references cut into many blocks."""
    _, vectors, refs = _vectorised(spark, sf)
    blocks = simjoin.nearest_reference(vectors, refs, block_values=4096)
    return blocks.select("row_id", r6("similarity_score").alias("similarity_score"))


@query
def keyword_match(spark, sf):
    return scoring.add_keyword_score(fx.threats(spark, sf), fx.KEYWORDS).select("row_id", "matched_keywords")


@query
def keyword_score(spark, sf):
    return scoring.add_keyword_score(fx.threats(spark, sf), fx.KEYWORDS).select(
        "row_id", "num_keywords_matched", r6("keyword_score").alias("keyword_score")
    )


@query
def risk_score(spark, sf):
    s = fx.scored(spark, sf)
    return s.select(
        "row_id",
        r6(scoring.risk_score()).alias("risk_score"),
        r6("similarity_score").alias("similarity_score"),
        r6("keyword_score").alias("keyword_score"),
        r6("novelty_score").alias("novelty_score"),
    )


@query
def score_threats(spark, sf):
    """All components and the ranked result, with the document source as the given cluster."""
    t, vectors, refs = _vectorised(spark, sf)
    rows = t.select("row_id", "description", F.substring("source", 4, 10).cast("int").alias("cluster")).join(
        vectors, "row_id"
    )
    centers = stage(clusters.cluster_centers(rows))
    spread = stage(clusters.cluster_spread(clusters.member_distances(rows, centers)))
    scored = scoring.score_threats(rows, refs, centers, spread, fx.KEYWORDS)
    return rounded(
        scored.select(
            "row_id",
            "risk_score",
            "similarity_score",
            "keyword_score",
            "novelty_score",
            "most_similar_idx",
            "matched_keywords",
            "num_keywords_matched",
            "cluster",
        ),
        "risk_score",
        "similarity_score",
        "keyword_score",
        "novelty_score",
    )


@query
def rescore(spark, sf):
    s = fx.scored(spark, sf).withColumn("risk_score", scoring.risk_score())
    new = scoring.rescore(s)
    return rounded(
        new.select("row_id", "risk_score", "risk_score_new", "risk_score_old"),
        "risk_score",
        "risk_score_new",
        "risk_score_old",
    )


@query
def rescore_comparison(spark, sf):
    s = fx.scored(spark, sf).withColumn("risk_score", scoring.risk_score())
    return rounded(
        reports.rescore_comparison(scoring.rescore(s, ordered=False)), "old_mean", "new_mean", "old_max", "new_max"
    )


def run_pipeline(spark: SparkSession, sf: str) -> pipeline.Run:
    return pipeline.run(
        fx.threats(spark, sf), fx.incidents(spark, sf), keywords=fx.KEYWORDS, weights=scoring.RESCORE_WEIGHTS
    )


def ranked_run(spark: SparkSession, sf: str) -> DataFrame:
    """The whole run, ranked."""
    done = run_pipeline(spark, sf)
    return done.ranked().select(
        "row_id",
        "name",
        "risk_score",
        "similarity_score",
        "keyword_score",
        "novelty_score",
        "most_similar_idx",
        "matched_keywords",
        "num_keywords_matched",
        "cluster",
    )


@query
def triage_pipeline(spark, sf):
    """The whole run: what does not depend on the solver's clusters, and whether the rest holds together."""
    weights = scoring.RESCORE_WEIGHTS
    gap = F.abs(F.col("risk_score") - scoring.risk_score(weights))
    return ranked_run(spark, sf).select(
        "row_id",
        "name",
        r6("similarity_score").alias("similarity_score"),
        "most_similar_idx",
        "matched_keywords",
        "num_keywords_matched",
        r6("keyword_score").alias("keyword_score"),
        F.col("novelty_score").between(0, 1).alias("novelty_in_range"),
        F.col("cluster").between(0, clusters.K - 1).alias("cluster_known"),
        (gap < 1e-9).alias("risk_is_weighted"),
    )


# --- aggregates ------------------------------------------------------------------------------------------------


def _profile(spark, sf):
    s = fx.scored(spark, sf)
    spread = stage(
        clusters.cluster_spread(s.select("cluster", F.col("novelty_score").alias("distance")), fx.N_CLUSTERS)
    )
    return clusters.cluster_profile(s, spread, fx.N_CLUSTERS)


@query
def cluster_profile(spark, sf):
    return rounded(_profile(spark, sf), "percentage", "std_dev")


@query
def top_tags(spark, sf):
    return clusters.top_tags(fx.scored(spark, sf))


@query
def sample_names(spark, sf):
    return clusters.sample_names(fx.scored(spark, sf))


@query
def cluster_summary(spark, sf):
    return clusters.cluster_summary(fx.scored(spark, sf), strip_tags=False)


@query
def cluster_size_summary(spark, sf):
    s = fx.scored(spark, sf)
    sizes = clusters.cluster_spread(s.select("cluster", F.lit(0.0).alias("distance")), fx.N_CLUSTERS)
    return rounded(clusters.cluster_size_summary(sizes), "avg_cluster_size")


@query
def score_distribution(spark, sf):
    d = statistics.score_distribution(fx.scored(spark, sf))
    return rounded(d, *d.columns)


@query
def band_counts(spark, sf):
    return rounded(reports.band_counts(fx.scored(spark, sf)), "percent")


@query
def kpis(spark, sf):
    filtered = reports.facet_filter(fx.scored(spark, sf), ["High", "Medium"])
    return rounded(reports.kpis(filtered), "high_risk_percent", "avg_risk", "avg_keywords")


@query
def score_histogram(spark, sf):
    return reports.score_histogram(fx.scored(spark, sf))


@query
def cluster_counts(spark, sf):
    return reports.cluster_counts(fx.scored(spark, sf))


@query
def timeline_monthly(spark, sf):
    return reports.timeline_monthly(fx.table(spark, sf, "orders"), "o_orderdate")


def _labelled(spark, sf) -> DataFrame:
    """The scored table with the independent toxicity label as its critical flag."""
    return fx.scored(spark, sf).drop("is_critical").withColumnRenamed("is_toxic", "is_critical")


@query
def precision_recall_at_k(spark, sf):
    return rounded(ranking.precision_recall_at_k(_labelled(spark, sf)), "precision", "recall", "f1")


@query
def baseline_random(spark, sf):
    return rounded(ranking.baseline_random(_labelled(spark, sf)), "recall")


@query
def baseline_recency(spark, sf):
    return rounded(ranking.baseline_recency(_labelled(spark, sf)), "recall")


@query
def baseline_comparison(spark, sf):
    return rounded(ranking.baseline_comparison(_labelled(spark, sf)), "recall", "improvement_percent")


# --- ranking ---------------------------------------------------------------------------------------------------


@query
def rank_threats(spark, sf):
    return rounded(scoring.rank_threats(fx.scored(spark, sf)).select("row_id", "risk_score"), "risk_score")


@query
def top_n(spark, sf):
    """The first 50 by each of the three orders."""
    s = fx.scored(spark, sf).select("row_id", "risk_score", "created_ts", "num_keywords_matched")
    parts = [ranking.ranked_head(s, 50, by).select(F.lit(by).alias("order_by"), "rank", "row_id") for by in ranking.SORTS]
    return reduce(DataFrame.unionByName, parts)


@query
def top10_report(spark, sf):
    old = fx.scored(spark, sf).withColumn("risk_score", scoring.risk_score())
    return rounded(ranking.top_report(scoring.rescore(old, ordered=False)), "risk_score", "risk_score_old")


@query
def component_profile(spark, sf):
    return rounded(
        ranking.component_profile(fx.scored(spark, sf)), "similarity_score", "keyword_score", "novelty_score"
    )


@query
def score_proximity(spark, sf):
    return rounded(reports.score_proximity(fx.scored(spark, sf)), "proximity")


@query
def collect_threats(spark, sf):
    """From landed pages to the written threat table that a run reads."""
    return pulses.collect(spark, fx.land_pages(spark, sf, stage_path(spark)), stage_path(spark))


@query
def score_with_saved(spark, sf):
    """Scores of all threats from a saved space: document frequencies, centers and spread read back from files."""
    t, vectors, _ = _vectorised(spark, sf)
    rows = t.withColumn("cluster", F.substring("source", 4, 10).cast("int"))
    own = stage(rows.select("row_id", "cluster").join(vectors, "row_id"))
    centers = stage(clusters.cluster_centers(own))
    spread = clusters.cluster_spread(clusters.member_distances(own, centers))
    folder = stage_path(spark)
    pipeline.save_space(vectorize.fit_idf(vectorize.term_counts(t)), centers, spread, folder)
    scored = pipeline.score_with_saved(rows, fx.incidents(spark, sf), folder, fx.KEYWORDS)
    names = ("risk_score", "similarity_score", "keyword_score", "novelty_score")
    return rounded(scored.select("row_id", *names, "most_similar_idx", "matched_keywords", "num_keywords_matched", "cluster"), *names)
