"""Report-shaped views over the test tables, for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftwatch.functions.bands import is_critical, risk_band
from siftwatch.operators import scoring
from siftwatch.sources import tables

# Words that occur in the test documents; the built-in lists hardly do.
KEYWORDS = ["license", "token", "rights", "apache", "nicht", "thing", "thble", "erble", "blend"]
LISTS = {
    "critical": ["license", "token", "rights"],
    "high": ["apache", "nicht", "token"],
    "medium": ["thing"],
    "group": ["thble", "error"],
    "family": ["erble", "blend"],
}
# Lies between scores that occur, unlike the default.
SIM_THRESHOLD = 0.40
VECTOR_THRESHOLD = 0.35
N_CLUSTERS = 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def threats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, e, l = (table(spark, sf_dir, t) for t in ("documents", "events", "labels"))
    return (
        tables.spread(d).join(l, "doc_id", "left")
        .join(e.select(F.col("event_id").alias("doc_id"), "ts", "value"), "doc_id", "left")
        .select(
            F.col("doc_id").alias("row_id"),
            F.col("doc_id").cast("string").alias("id"),
            F.substring("text", 1, 60).alias("name"),
            F.col("text").alias("description"),
            F.concat_ws(
                ", ",
                "lang",
                "source",
                F.when(F.col("toxic") == 1, "toxic"),
                F.when(F.col("quality") == 0, "junk"),
            ).alias("tags"),
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_date"),
            F.col("ts").alias("created_ts"),
            "source",
            "n_chars",
            "value",
            "quality",
            "toxic",
        )
    )


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("int").alias("idx"),
        F.concat(F.lit("INC-"), F.col("item_id").cast("string")).alias("id"),
        F.substring("text", 1, 30).alias("name"),
        F.col("text").alias("description"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scored table whose components are plain functions of the test columns; the keyword part is real."""
    t = threats(spark, sf_dir)
    with_parts = scoring.add_keyword_score(t, KEYWORDS).select(
        "row_id",
        "id",
        "name",
        "description",
        "tags",
        "created_date",
        "created_ts",
        "source",
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("is_toxic"),
        ((F.col("n_chars") * 7919 % 1000).cast("double") / 1000.0).alias("similarity_score"),
        "keyword_score",
        F.least(F.col("value") / 100.0, F.lit(1.0)).alias("novelty_score"),
        (F.col("n_chars") % 45).cast("int").alias("most_similar_idx"),
        "matched_keywords",
        "num_keywords_matched",
        F.substring("source", 4, 10).cast("int").alias("cluster"),
    )
    return with_parts.withColumn("risk_score", scoring.risk_score(scoring.RESCORE_WEIGHTS)).withColumns(
        {
            "risk_category": risk_band("risk_score"),
            "is_critical": is_critical(sim_threshold=0.55),
        }
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"), "embedding", F.col("label").alias("cluster")
    )


def pulse_pages(spark: SparkSession, sf_dir: str, per_page: int = 50) -> DataFrame:
    """Documents as nested feed pages of 50, through JSON text as they would be landed."""
    from siftwatch.sources.schemas import PULSE_PAGE

    d = table(spark, sf_dir, "documents")
    tags = F.array(F.initcap("lang"), F.col("source"), F.when(F.col("n_chars") % 3 == 0, "Supply").otherwise("Exploit kit"), F.lit("CHAIN"))
    pulse = F.struct(
        F.col("doc_id").alias("pos"),
        F.struct(
            F.col("doc_id").cast("string").alias("id"),
            F.concat(F.lit("  "), F.substring("text", 1, 40), F.lit(" \n")).alias("name"),
            F.col("text").alias("description"),
            F.lit("2024-01-01").alias("created"),
            tags.alias("tags"),
            F.array(F.col("source"), F.col("lang")).alias("references"),
            F.when(F.col("doc_id") % 2 == 0, F.struct(F.col("source").alias("username"))).alias("author"),
        ).alias("pulse"),
    )
    pages = d.groupBy(F.floor(F.col("doc_id") / per_page).alias("page")).agg(
        F.transform(F.array_sort(F.collect_list(pulse)), lambda p: p["pulse"]).alias("results")
    )
    landed = pages.select("page", F.to_json(F.struct("results")).alias("body"))
    return landed.select("page", F.from_json("body", PULSE_PAGE).alias("b")).select("page", "b.results")


def land_pages(spark: SparkSession, sf_dir: str, folder: str) -> str:
    """The pages as landed JSON files, in folders ``page=N``, with an empty page among them."""
    pages = pulse_pages(spark, sf_dir).select(F.col("page").cast("bigint"), F.to_json(F.struct("results")).alias("body"))
    empty = spark.createDataFrame([(7_000_000, '{"results": []}')], "page bigint, body string")
    pages.unionByName(empty).repartition("page").write.partitionBy("page").text(folder)
    return folder
