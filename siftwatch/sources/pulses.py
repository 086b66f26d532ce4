"""Landed feed pages: flattening, normalising and the quality filter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from siftwatch.functions import text as T
from siftwatch.operators.skew import renumber
from siftwatch.sources import tables
from siftwatch.sources.schemas import PULSE_PAGE, THREAT

# A report is relevant when its tags hold one of these.
RELEVANT_TAGS = [
    "malware", "ransomware", "phishing", "apt", "trojan", "backdoor", "exploit", "vulnerability", "botnet",
    "supply chain", "zero-day", "threat actor",
]
MIN_DESCRIPTION_LENGTH = 100


def read_pulse_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON pages, one per file: ``(page, file, results)``.

    A page's number is that of its ``page=N`` folder, or else the last number in its file name; a file with neither is
    an error. Files of equal number in different folders are pages of their own, in the order of their paths.
    """
    pages = spark.read.schema(PULSE_PAGE).option("multiLine", True).json(path)
    file, name = F.col("_metadata.file_path"), F.col("_metadata.file_name")
    folder, last = F.regexp_extract(file, r"/page=(\d+)/", 1), F.regexp_extract(name, r"(\d+)\D*$", 1)
    none = F.raise_error(F.concat(F.lit("no page number in "), file))
    number = F.when(folder != "", folder).when(last != "", last).otherwise(none)
    return pages.select(number.cast("bigint").alias("page"), file.alias("file"), "results")


def flatten_pulse_pages(pages: DataFrame, max_pulses: int | None = None, end_at_empty: bool = False) -> DataFrame:
    """Pages ``(page, results)``, perhaps with ``file``, to one row per pulse, in page order.

    ``end_at_empty`` treats the pages as a live feed, which an empty page ends: it and everything after it is not
    read. Landed pages are all read. ``max_pulses`` keeps the first ones.
    """
    order = [c for c in ("page", "file") if c in pages.columns]
    if end_at_empty:
        empty = pages.where(F.coalesce(F.size("results"), F.lit(0)) <= 0)
        # As a struct the answer is never NULL and both uses share one subquery.
        first_empty = empty.agg(F.struct(F.min("page").alias("page")).alias("first")).scalar()["page"]
        pages = pages.where(F.coalesce(F.col("page") < first_empty, first_empty.isNull()))
    pulses = pages.select(*order, F.posexplode("results").alias("pos", "pulse")).select(*order, "pos", "pulse.*")
    first = pulses.orderBy(*order, "pos").limit(max_pulses) if max_pulses is not None else pulses
    return first.drop("file")


def normalise_pulses(pulses: DataFrame, source: str = "feed") -> DataFrame:
    """Nested pulses to flat text columns; missing values take their defaults; other columns pass through."""
    empty = F.array().cast("array<string>")
    tags = F.coalesce("tags", empty)
    replaced = {"id", "name", "description", "created", "tags", "references", "author"}
    return pulses.select(
        *[c for c in pulses.columns if c not in replaced],
        F.coalesce("id", F.lit("")).alias("id"),
        T.strip(F.coalesce("name", F.lit(""))).alias("name"),
        T.strip(F.coalesce("description", F.lit(""))).alias("description"),
        F.lower(F.array_join(tags, ", ")).alias("tags"),
        F.lower(F.array_join(tags, " ")).alias("tag_text"),
        F.coalesce("created", F.lit("")).alias("created_date"),
        F.array_join(F.coalesce("references", empty), ", ").alias("references"),
        F.lit(source).alias("source"),
        F.coalesce(F.col("author.username"), F.lit("Unknown")).alias("author"),
    )


def quality_filter(
    rows: DataFrame,
    min_description_length: int = MIN_DESCRIPTION_LENGTH,
    relevant_tags: Sequence[str] = RELEVANT_TAGS,
) -> DataFrame:
    """Normalised rows that are long enough, carry a relevant tag and have a name."""
    return rows.where(
        (F.length("description") >= min_description_length)
        & T.contains_any("tag_text", relevant_tags)
        & (F.col("name") != "")
    ).drop("tag_text")


def collection_summary(
    rows: DataFrame,
    min_description_length: int = MIN_DESCRIPTION_LENGTH,
    relevant_tags: Sequence[str] = RELEVANT_TAGS,
) -> DataFrame:
    """Raw and kept counts, filter rate in percent and the kept date range, in one pass."""
    kept = (
        (F.length("description") >= min_description_length)
        & T.contains_any("tag_text", relevant_tags)
        & (F.col("name") != "")
    )
    counted = rows.select(kept.alias("kept"), "created_date").agg(
        F.count(F.lit(1)).alias("raw"),
        F.count_if("kept").alias("kept"),
        F.min(F.when(F.col("kept"), F.col("created_date"))).alias("min_created"),
        F.max(F.when(F.col("kept"), F.col("created_date"))).alias("max_created"),
    )
    rate = (F.lit(1.0) - F.try_divide(F.col("kept").cast("double"), F.col("raw").cast("double"))) * 100.0
    return counted.select("raw", "kept", rate.alias("filter_rate"), "min_created", "max_created")


def collect(spark: SparkSession, pages: str, out: str, source: str = "feed", **options) -> DataFrame:
    """Landed pages to a written threat table, the one that a run reads: kept rows, numbered in feed order."""
    flat = normalise_pulses(flatten_pulse_pages(read_pulse_pages(spark, pages), **options), source)
    kept = quality_filter(flat).withColumn("_place", F.struct("page", "pos"))
    numbered = renumber(kept, "_place", "row_id")
    columns = [f.name for f in StructType.fromDDL(THREAT)]
    tables.write_threats(numbered.select(*columns), out)
    return tables.scan_threats(spark, out)
