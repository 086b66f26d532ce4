"""Clusters: k-means, assignment, spread, novelty and profiles."""

from __future__ import annotations

from collections.abc import Iterator
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from siftwatch.functions import arrays, text as T
from siftwatch.functions.vectors import as_double, euclidean
from siftwatch.operators.simjoin import extended
from siftwatch.operators.skew import lookup_join
from siftwatch.staging import stage

K = 10
RESTARTS = 10
MAX_ITER = 300
SEED = 42
PARALLEL_FITS = 5
TOP_TAGS = 5
SAMPLES = 3
# A spread below this counts as none.
MIN_SPREAD = 1e-6


def kmeans_fit(
    df: DataFrame,
    k: int = K,
    vector: str = "embedding",
    restarts: int = RESTARTS,
    max_iter: int = MAX_ITER,
    seed: int = SEED,
    parallelism: int = PARALLEL_FITS,
) -> KMeansModel:
    """Best of ``restarts`` k-means fits by total squared distance, the earliest of equals.

    Pass a written table: the points kept in memory are rebuilt from it when an executor is lost. The fits are
    independent Spark jobs, ``parallelism`` of them at a time.
    """
    features = df.select(array_to_vector(as_double(vector)).alias("features"))
    # Hundreds of passes follow, so one shuffle into even partitions pays.
    sc = df.sparkSession.sparkContext
    points = features.repartition(max(sc.defaultParallelism, features.rdd.getNumPartitions()))
    points = points.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        points.count()
        solvers = [
            KMeans(k=k, maxIter=max_iter, seed=seed + r, tol=1e-4, featuresCol="features") for r in range(restarts)
        ]
        with ThreadPool(parallelism) as pool:
            fits = pool.map(inheritable_thread_target(df.sparkSession)(lambda s: s.fit(points)), solvers)
        return min(fits, key=lambda m: m.summary.trainingCost)
    finally:
        points.unpersist()


def model_centers(model: KMeansModel) -> list[list[float]]:
    return [c.tolist() for c in model.clusterCenters()]


def assign_clusters(df: DataFrame, centers, vector: str = "embedding", name: str = "cluster") -> DataFrame:
    """Adds the nearest center's position and the distance to it; the lowest position wins ties."""
    if centers is None or not len(centers):
        raise ValueError("assign_clusters needs fitted centers")
    c = np.asarray(centers, dtype=np.float64)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = arrays.matrix(batch.column(vector))
            square = np.stack([((m - one) ** 2).sum(axis=1) if len(m) else np.zeros(0) for one in c], axis=1)
            at = square.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(at.astype(np.int32)), pa.array(np.sqrt(square[np.arange(len(at)), at]))],
                names=[*batch.schema.names, name, "distance"],
            )

    return df.mapInArrow(nearest, extended(df, f"{name} int, distance double"))


def cluster_centers(df: DataFrame, vector: str = "embedding", cluster: str = "cluster") -> DataFrame:
    """``(cluster_id, center, size)``: the mean vector per cluster, combined before the shuffle."""
    return (
        df.select(F.col(cluster).alias("cluster_id"), array_to_vector(as_double(vector)).alias("v"))
        .groupBy("cluster_id")
        .agg(Summarizer.mean(F.col("v")).alias("m"), F.count(F.lit(1)).alias("size"))
        .select("cluster_id", vector_to_array("m").alias("center"), "size")
    )


def member_distances(df: DataFrame, centers: DataFrame, vector: str = "embedding", cluster: str = "cluster") -> DataFrame:
    """Adds ``distance`` to the row's own center, NULL without one. ``centers``, one row per cluster id, is a written or
    literal table."""
    own = centers.select(F.col("cluster_id").alias(cluster), "center")
    return lookup_join(df, own, cluster, "left").withColumn("distance", euclidean(vector, "center")).drop("center")


def cluster_spread(distances: DataFrame, k: int | None = None, cluster: str = "cluster") -> DataFrame:
    """Population standard deviation of the member distances per cluster, with sizes.

    With ``k`` all ids 0..k-1 appear, empty ones with spread 0.
    """
    spread = distances.groupBy(F.col(cluster).alias("cluster_id")).agg(
        F.stddev_pop("distance").alias("std_dev"), F.count(F.lit(1)).alias("size")
    )
    if k is None:
        return spread
    ids = distances.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster_id"))
    return ids.join(spread, "cluster_id", "left").select(
        "cluster_id", F.coalesce("std_dev", F.lit(0.0)).alias("std_dev"), F.coalesce("size", F.lit(0)).alias("size")
    )


def inertia(distances: DataFrame) -> DataFrame:
    return distances.agg(F.sum(F.col("distance") * F.col("distance")).alias("inertia"))


def novelty_z(distance: Column, std_dev: Column) -> Column:
    """How far outside two spreads the row lies, in units of two spreads, without limits."""
    return F.when(std_dev < MIN_SPREAD, F.lit(0.0)).otherwise(
        F.try_divide(distance - F.lit(2.0) * std_dev, F.lit(2.0) * std_dev)
    )


def add_novelty(distances: DataFrame, spread: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Adds ``novelty_z`` and ``novelty_score`` (the same, limited to 0..1). ``spread`` is a written table. A row
    without a known cluster keeps its place, with novelty 0."""
    own = spread.select(F.col("cluster_id").alias(cluster), "std_dev")
    z = novelty_z(F.col("distance"), F.col("std_dev"))
    return (
        lookup_join(distances, own, cluster, "left")
        .withColumn("novelty_z", F.coalesce(z, F.lit(0.0)))
        .withColumn("novelty_score", F.least(F.greatest(F.col("novelty_z"), F.lit(0.0)), F.lit(1.0)))
        .drop("std_dev")
    )


def top_tags(
    df: DataFrame,
    n: int = TOP_TAGS,
    strip_tags: bool = True,
    cluster: str = "cluster",
    tags: str = "tags",
) -> DataFrame:
    """``(cluster, tag, n_rows, rank)``: the most common tags per cluster; ties go to the tag seen first.

    Counts are combined before the shuffle, and the rank limit is applied on both sides of the second one.
    """
    # One entry per row and tag with its count and first place, so that plain numbers are aggregated (by hash).
    seen = (
        df.where(F.col(tags).isNotNull())
        .select(cluster, "row_id", T.tag_array(tags, strip_tags).alias("_tags"))
        .select(cluster, "row_id", "_tags", F.explode(F.array_distinct("_tags")).alias("tag"))
        .select(
            cluster,
            "row_id",
            "tag",
            F.size(F.filter("_tags", lambda t: t == F.col("tag"))).alias("n"),
            F.array_position("_tags", F.col("tag")).alias("pos"),
        )
        .groupBy(cluster, "tag")
        .agg(
            F.sum("n").alias("n_rows"),
            F.min("row_id").alias("first_row"),
            F.min_by("pos", "row_id").alias("first_pos"),
        )
    )
    order = W.partitionBy(cluster).orderBy(F.desc("n_rows"), "first_row", "first_pos")
    return (
        seen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select(cluster, "tag", "n_rows", "rank")
    )


def _joined(df: DataFrame, cluster: str, value: str, order: str, separator: str, name: str) -> DataFrame:
    """The few ranked values of each cluster as one text."""
    ordered = F.array_sort(F.collect_list(F.struct(order, value)))
    return df.groupBy(cluster).agg(F.array_join(F.transform(ordered, lambda s: s[value]), separator).alias(name))


def sample_names(
    df: DataFrame, n: int = SAMPLES, width: int = 40, cluster: str = "cluster", name: str = "name"
) -> DataFrame:
    """``(cluster, sample, rank)``: the first names per cluster in row order, cut and always followed by dots."""
    order = W.partitionBy(cluster).orderBy("row_id")
    return (
        df.select(cluster, "row_id", F.concat(T.head(name, width), F.lit("...")).alias("sample"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= n)
        .select(cluster, "sample", "rank")
    )


def cluster_profile(df: DataFrame, spread: DataFrame, k: int, cluster: str = "cluster") -> DataFrame:
    """One row per cluster id 0..k-1, empty ones included: size, share in percent, tags, samples and spread. The input
    is read once, for a written projection."""
    df = stage(df.select(cluster, "row_id", "name", "tags"))
    ids = df.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster_id"))
    sizes = df.groupBy(F.col(cluster).alias("cluster_id")).agg(F.count(F.lit(1)).alias("size"))
    total = df.agg(F.count(F.lit(1)).cast("double").alias("n")).scalar()
    tags = _joined(top_tags(df, cluster=cluster), cluster, "tag", "rank", ", ", "top_tags")
    samples = _joined(sample_names(df, cluster=cluster), cluster, "sample", "rank", " | ", "sample_threats")
    n = F.coalesce("size", F.lit(0))
    return (
        ids.join(sizes, "cluster_id", "left")
        .join(tags.withColumnRenamed(cluster, "cluster_id"), "cluster_id", "left")
        .join(samples.withColumnRenamed(cluster, "cluster_id"), "cluster_id", "left")
        .join(spread.select("cluster_id", "std_dev"), "cluster_id", "left")
        .select(
            "cluster_id",
            n.alias("size"),
            (F.try_divide(n.cast("double"), total) * 100.0).alias("percentage"),
            F.coalesce("top_tags", F.lit("N/A")).alias("top_tags"),
            F.coalesce("sample_threats", F.lit("")).alias("sample_threats"),
            F.coalesce("std_dev", F.lit(0.0)).alias("std_dev"),
        )
        .orderBy(F.desc("size"), "cluster_id")
    )


def cluster_summary(df: DataFrame, strip_tags: bool = True, cluster: str = "cluster") -> DataFrame:
    """The clusters present: row count, top tags and sample names. The input is read once, for a written projection."""
    df = stage(df.select(cluster, "row_id", "name", "tags"))
    sizes = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n_rows"))
    tags = _joined(top_tags(df, strip_tags=strip_tags, cluster=cluster), cluster, "tag", "rank", ", ", "top_tags")
    samples = _joined(sample_names(df, cluster=cluster), cluster, "sample", "rank", " | ", "sample_threats")
    return sizes.join(tags, cluster, "left").join(samples, cluster)


def cluster_size_summary(sizes: DataFrame, noise_id: int = -1) -> DataFrame:
    """Clusters present, noise rows, and mean, largest and smallest size over ``sizes (cluster_id, size)``, which
    also lists empty clusters."""
    real = F.when(F.col("cluster_id") != noise_id, F.col("size"))
    return sizes.agg(
        F.count_if((F.col("cluster_id") != noise_id) & (F.col("size") > 0)).alias("num_clusters"),
        F.coalesce(F.sum(F.when(F.col("cluster_id") == noise_id, F.col("size"))), F.lit(0)).cast("bigint").alias("noise_points"),
        F.avg(real).alias("avg_cluster_size"),
        F.max(real).alias("max_cluster_size"),
        F.min(real).alias("min_cluster_size"),
    )
