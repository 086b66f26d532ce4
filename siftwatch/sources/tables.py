"""Scans and sinks. Parquet is the default form; CSV is for exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from siftwatch.functions.bands import parse_timestamp, risk_band
from siftwatch.sources import schemas
from siftwatch.staging import stage

# Quotes and line breaks inside a text are kept, and blanks at its ends are data.
CSV_OPTIONS = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "multiLine": True,
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def scan(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", **options) -> DataFrame:
    """A typed scan; a missing path is an error, and so is a missing column.

    Columns are found by name. CSV is read by its header and in strict mode; a file without ``row_id`` gets one from
    its rows' places, as such files are kept in order.
    """
    reader = spark.read.options(**{**(CSV_OPTIONS if fmt == "csv" else {}), **options}).format(fmt)
    there = reader.load(path)
    wanted = [(f.name, f.dataType) for f in StructType.fromDDL(schema)]
    absent = [n for n, _ in wanted if n not in there.columns and n != "row_id"]
    if absent:
        raise ValueError(f"{path} lacks {', '.join(absent)}")
    if fmt != "csv":
        numbered = there if "row_id" in there.columns or "row_id" not in dict(wanted) else with_row_id(there)
        return numbered.select(*(F.col(n).cast(t).alias(n) for n, t in wanted))
    types = dict(wanted)
    strict = ", ".join(f"`{c}` {types[c].simpleString() if c in types else 'string'}" for c in there.columns)
    rows = reader.schema(strict).option("mode", "FAILFAST").option("enforceSchema", False).load(path)
    if "row_id" in types and "row_id" not in there.columns:
        rows = with_row_id(rows)
    return rows.select(*(n for n, _ in wanted))


def with_row_id(rows: DataFrame) -> DataFrame:
    """``row_id`` by place: file by file in the order of their paths, line by line. The rows are written once, so that
    the numbers stay."""
    spot = F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
    placed = stage(rows.select("*", spot.alias("_spot")))
    files = placed.groupBy("_spot.file").agg(F.count(F.lit(1)).alias("n"), F.min("_spot.line").alias("first"))
    # One row per file, summed in one task.
    ahead = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("file", (F.coalesce(F.sum("n").over(ahead), F.lit(0))).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_spot.file").orderBy("_spot.line")) - 1
    numbered = placed.withColumn("_line", inside).withColumn("file", F.col("_spot.file")).join(starts, "file")
    return numbered.withColumn("row_id", (F.col("_start") + F.col("_line")).cast("bigint")).drop("_spot", "_line", "_start", "file")


def spread(scanned: DataFrame) -> DataFrame:
    """A scan with fewer splits than the cluster has cores (one small file) is dealt out to all of them; any larger
    scan stays as it is, without a shuffle."""
    cores = scanned.sparkSession.sparkContext.defaultParallelism
    return scanned.repartition(cores) if scanned.rdd.getNumPartitions() < cores else scanned


def scan_threats(spark: SparkSession, path: str, fmt: str = "parquet", schema: str = schemas.THREAT) -> DataFrame:
    return scan(spark, path, schema, fmt)


def scan_scored(spark: SparkSession, path: str, fmt: str = "parquet", schema: str = schemas.SCORED) -> DataFrame:
    """Scored rows with their band and a parsed date (unreadable dates become NULL)."""
    return dashboard_view(scan(spark, path, schema, fmt))


def dashboard_view(scored: DataFrame) -> DataFrame:
    return scored.withColumns(
        {"risk_category": risk_band("risk_score"), "created_ts": parse_timestamp("created_date")}
    )


def scan_cluster_stats(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Cluster profiles; the written placeholder for "no tags", and empty samples, read back as NULL in any format."""
    stats = scan(spark, path, schemas.CLUSTER_STATS, fmt)
    return stats.withColumns({"top_tags": F.nullif(F.col("top_tags"), F.lit("N/A")), "sample_threats": F.nullif(F.col("sample_threats"), F.lit(""))})


def write(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = (), mode="overwrite"):
    writer = df.write.mode(mode)
    if fmt == "csv":
        # Spark's CSV writer has no multiLine switch: it quotes line breaks by itself.
        writer = writer.options(**{k: v for k, v in CSV_OPTIONS.items() if k != "multiLine"})
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(fmt).save(path)


def write_threats(threats: DataFrame, path: str, fmt: str = "parquet") -> None:
    write(threats, path, fmt)


def write_duplicate_report(report: DataFrame, path: str, fmt: str = "parquet") -> bool:
    """Replaces the last run's report, by an empty one if there is nothing to report; says whether there is."""
    spark = report.sparkSession
    write(typed(report, schemas.DUPLICATE_REPORT), path, fmt)
    return not scan(spark, path, schemas.DUPLICATE_REPORT, fmt).isEmpty()


def write_cluster_stats(stats: DataFrame, path: str, fmt: str = "parquet") -> None:
    write(stats, path, fmt)


def write_scored(scored: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Scored or re-scored rows by band, each file in rank order; band folders let readers skip the rest."""
    banded = scored if "risk_category" in scored.columns else scored.withColumn("risk_category", risk_band())
    ranked = banded.sortWithinPartitions("risk_category", F.desc("risk_score"), "row_id")
    write(ranked, path, fmt, partition_by=("risk_category",))


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Vectors with their cluster labels, as columns keyed by ``row_id``."""
    write(vectors, path)


def typed(df: DataFrame, schema: str) -> DataFrame:
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)))


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Adds a run's metrics to those of other runs; a repeated run replaces its own."""
    writer = typed(metrics, schemas.METRICS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("run_id").parquet(path)
