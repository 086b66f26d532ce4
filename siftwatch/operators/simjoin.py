"""Exact cosine similarity joins on dense vectors, as bounded tiles of matrix products.

Rows are grouped into regions (nearest pivot, then rings of distance around it) and every region is cut by hash
into blocks of about ``block_rows`` rows. A tile is a pair of blocks; it is computed only when the triangle
inequality on angles allows a pair above the threshold between the two regions. There are at most ``MAX_PIVOTS``
pivots with ``MAX_RINGS`` rings, so the region table stays small whatever row count and threshold are; tiles are bounded
in rows, and block sizes do not depend on how the vectors are distributed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs, parquet
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from siftwatch.functions import arrays
from siftwatch.staging import stage, stage_path

BLOCK_ROWS = 2048
MAX_PIVOTS = 32
# Tasks that the tiles are dealt to at most.
TASKS = 2000
RINGS_PER_THETA = 4
# Rings around one pivot at most, however narrow the threshold: the region table and its links stay bounded.
MAX_RINGS = 64
# Room for rounding in the angle bounds; only ever lets more tiles through.
ANGLE_SLACK = 1e-6
# Numbers in one block of reference vectors, and of the rows and products worked on at once.
REFERENCE_VALUES = 1_000_000
BATCH_VALUES = 500_000

PAIR_SCHEMA = "i bigint, j bigint, sim double"


def extended(df: DataFrame, added: str) -> StructType:
    """The schema of ``df`` with further columns, for tasks that pass their input through."""
    return StructType([*df.schema.fields, *StructType.fromDDL(added).fields])


def unit_vectors(df: DataFrame, vector: str = "embedding", key: str = "row_id") -> DataFrame:
    """``(row_id, unit, self_sim)`` with every vector divided by (its norm + 1e-8)."""

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = arrays.unit_rows(arrays.matrix(batch.column(1)))
            own = np.einsum("ij,ij->i", unit, unit)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), arrays.vectors(unit), pa.array(own)], names=["row_id", "unit", "self_sim"]
            )

    rows = df.select(F.col(key).cast("bigint").alias("row_id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.mapInArrow(scale, "row_id bigint, unit array<double>, self_sim double")


def copy_key(vector: str = "unit"):
    """A 128-bit key of a vector; equal vectors have equal keys."""
    return F.struct(F.xxhash64(vector).alias("a"), F.xxhash64(F.reverse(vector), F.lit(1)).alias("b"))


@dataclass(frozen=True)
class _Regions:
    rows: DataFrame  # (row_id, unit, ..., region)
    links: list[tuple[int, int, int, int]]  # region, region, blocks of the first, blocks of the second


def _regions(units: DataFrame, threshold: float, n_pivots: int, block_rows: int) -> _Regions:
    theta = math.acos(min(1.0, max(-1.0, threshold))) + ANGLE_SLACK
    sample = units.select("row_id", "unit").orderBy(F.md5(F.col("row_id").cast("string"))).limit(n_pivots)
    pivots = np.array([r.unit for r in sample.collect()])
    ring = max(theta / RINGS_PER_THETA, math.pi / MAX_RINGS)
    per_pivot = int(math.pi / ring) + 2
    extra = [f for f in units.schema.fields if f.name not in ("row_id", "unit")]
    schema = extended(units, "region int, angles array<double>")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = arrays.matrix(batch.column("unit"))
            angle = np.arccos(np.clip(m @ pivots.T, -1.0, 1.0))
            home = angle.argmin(axis=1)
            region = home * per_pivot + (angle[np.arange(len(m)), home] / ring).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(region.astype(np.int32)), arrays.vectors(angle)],
                names=[*batch.schema.names, "region", "angles"],
            )

    placed = stage(units.mapInArrow(place, schema))
    boxes = (
        placed.select("region", F.posexplode("angles").alias("p", "angle"))
        .groupBy("region", "p")
        .agg(F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.count(F.lit(1)).alias("n"))
        .toPandas()
    )
    lo, hi = boxes.pivot(index="region", columns="p", values="lo"), boxes.pivot(index="region", columns="p", values="hi")
    size = boxes[boxes["p"] == 0].set_index("region")["n"]
    ids, low, high = lo.index.to_numpy(), lo.to_numpy(), hi.to_numpy()
    links = []
    for at, region in enumerate(ids):
        gap = np.maximum(low[at:] - high[at], low[at] - high[at:]).max(axis=1)
        for other in ids[at:][gap <= theta]:
            links.append(
                (
                    int(region),
                    int(other),
                    math.ceil(size[region] / block_rows),
                    math.ceil(size[other] / block_rows),
                )
            )
    return _Regions(placed.select("row_id", "unit", *[f.name for f in extra], "region"), links)


def _tile_pairs(regions: _Regions, threshold: float | None, emit, schema: str, alive: bool = False) -> DataFrame:
    """``emit(ids, i, j, sim, rows)`` of every tile: row ids, places and values of its qualifying pairs, and the tile's
    rows. Blocks are written once; the task of a tile reads its two blocks, so that rows are dealt out once and not
    once per tile. With ``alive``, a column of that name, only the rows where it is set are multiplied, and only with
    those where it is not."""
    spark = regions.rows.sparkSession
    folder = stage_path(spark)
    table = spark.createDataFrame(regions.links, "r1 int, r2 int, n1 int, n2 int")
    sizes = F.broadcast(table.where("r1 = r2").select(F.col("r1").alias("region"), F.col("n1").alias("_n")))
    block = F.pmod(F.xxhash64("row_id"), F.col("_n")).cast("int")
    rows = regions.rows.where("row_id IS NOT NULL").join(sizes, "region").withColumn("block", block).drop("_n")
    rows.repartition("region", "block").write.partitionBy("region", "block").parquet(folder)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r1, b1, r2, b2 in zip(*(batch.column(c).to_pylist() for c in ("r1", "b1", "r2", "b2"))):
                a, b = _block(folder, r1, b1), _block(folder, r2, b2)
                if a is None or b is None:
                    continue
                same = (r1, b1) == (r2, b2)
                ids = a[0] if same else np.concatenate([a[0], b[0]])
                rest = a[2] if same else pa.concat_tables([a[2], b[2]])
                parts = [_mixed_pairs(a, b, same, threshold)] if alive else _block_pairs(a, b, same, threshold)
                for x, y, value in parts:
                    if not len(x):
                        continue
                    left, right = x, y if same else y + len(a[0])
                    swap = ids[left] > ids[right]
                    found = emit(ids, np.where(swap, right, left), np.where(swap, left, right), value, rest)
                    yield from found.to_batches()

    # Within one region a block pair is computed once: the first block number is not above the second.
    from_block = F.when(F.col("r1") == F.col("r2"), F.col("b1")).otherwise(F.lit(0))
    tiles = table.withColumn("b1", F.explode(F.sequence(F.lit(0), F.col("n1") - 1)))
    tiles = tiles.withColumn("b2", F.explode(F.sequence(from_block, F.col("n2") - 1))).select("r1", "b1", "r2", "b2")
    n = sum(n1 * n2 for _, _, n1, n2 in regions.links)
    return tiles.repartition(max(1, min(TASKS, n))).sortWithinPartitions("r1", "b1", "r2", "b2").mapInArrow(compare, schema)


def _block_pairs(a, b, same: bool, threshold: float | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places and values of the pairs of two blocks. Without a threshold that is every pair, a few rows of the first
    block at a time."""
    step = len(a[0]) if threshold is not None else max(1, BATCH_VALUES // len(b[0]))
    for start in range(0, len(a[0]), step):
        rows = slice(start, start + step)
        sims = a[1][rows] @ b[1].T
        keep = sims >= threshold if threshold is not None else a[0][rows, None] != b[0][None, :]
        if same:
            keep &= a[0][rows, None] < a[0][None, :]
        x, y = np.nonzero(keep)
        yield x + start, y, sims[x, y]


def _mixed_pairs(a, b, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and values of the pairs of two blocks of which exactly one row is alive."""
    live_a, live_b = (x[2].column("alive").to_numpy() for x in (a, b))
    out = []
    for of_a, of_b in ((live_a, ~live_b),) if same else ((live_a, ~live_b), (~live_a, live_b)):
        rows, columns = np.flatnonzero(of_a), np.flatnonzero(of_b)
        sims = a[1][rows] @ b[1][columns].T
        x, y = np.nonzero(sims >= threshold)
        out.append((rows[x], columns[y], sims[x, y]))
    return tuple(np.concatenate(x) for x in zip(*out))


@lru_cache(4)
def _block(folder: str, region: int, block: int) -> tuple[np.ndarray, np.ndarray, pa.Table] | None:
    """Ids, vectors and other columns of one written block."""
    store, place = fs.FileSystem.from_uri(folder)
    path = f"{place}/region={region}/block={block}"
    if store.get_file_info(path).type == fs.FileType.NotFound:
        return None
    table = parquet.read_table(path, filesystem=store, partitioning=None)
    return table.column("row_id").to_numpy(), arrays.matrix(table.column("unit")), table.drop_columns(["row_id", "unit"])


def pivot_count(n_rows: int, block_rows: int = BLOCK_ROWS) -> int:
    """No pivots for a handful of blocks, then one per four blocks up to the maximum."""
    return max(1, min(MAX_PIVOTS, n_rows // (4 * block_rows)))


def pairs_above(
    units: DataFrame, threshold: float, n_pivots: int | None = None, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """All ``(i, j, sim)`` with ``i < j`` and similarity at or above ``threshold``, exactly."""
    pivots = n_pivots or pivot_count(units.count(), block_rows)
    regions = _regions(units.select("row_id", "unit"), threshold, pivots, block_rows)

    def emit(ids, i, j, sim, _) -> pa.Table:
        return pa.table({"i": ids[i], "j": ids[j], "sim": sim})

    return _tile_pairs(regions, threshold, emit, PAIR_SCHEMA)


def first_neighbours(units: DataFrame, threshold: float, most: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Like ``pairs_above``, but per tile a row reports only its ``most`` smallest neighbours.

    ``cut`` is set on all reported pairs of a row whose list in that tile was longer. Output grows with the rows,
    not with the number of pairs, so a dense group of near copies costs no quadratic output.
    """
    pivots = pivot_count(units.count(), block_rows)
    regions = _regions(units.select("row_id", "unit"), threshold, pivots, block_rows)

    def emit(ids, i, j, sim, _) -> pa.Table:
        i, j = ids[i], ids[j]
        order = np.lexsort((i, j))
        i, j, sim = i[order], j[order], sim[order]
        _, start, n = np.unique(j, return_index=True, return_counts=True)
        nth = np.arange(len(j)) - np.repeat(start, n)
        keep = nth < most
        return pa.table({"i": i[keep], "j": j[keep], "sim": sim[keep], "cut": np.repeat(n > most, n)[keep]})

    return _tile_pairs(regions, threshold, emit, f"{PAIR_SCHEMA}, cut boolean")


def _alive_regions(units: DataFrame, threshold: float, alive: str, block_rows: int) -> _Regions:
    rows = units.select("row_id", "unit", F.col(alive).alias("alive"))
    return _regions(rows, threshold, pivot_count(units.count(), block_rows), block_rows)


def survivor_pairs(
    units: DataFrame, threshold: float, alive: str = "alive", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Pairs from a surviving row to a later removed row; ``alive`` tells the two apart."""

    def emit(ids, i, j, sim, rest) -> pa.Table:
        live = rest.column("alive").to_numpy()
        keep = live[i] & ~live[j]
        return pa.table({"i": ids[i[keep]], "j": ids[j[keep]], "sim": sim[keep]})

    return _tile_pairs(_alive_regions(units, threshold, alive, block_rows), threshold, emit, PAIR_SCHEMA, alive=True)


def matched_rows(units: DataFrame, threshold: float, alive: str = "alive", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(row_id)`` of the rows not ``alive`` that a smaller ``alive`` row matches: one per row and tile, no pairs."""

    def emit(ids, i, j, sim, rest) -> pa.Table:
        live = rest.column("alive").to_numpy()
        return pa.table({"row_id": np.unique(ids[j[live[i] & ~live[j]]])})

    regions = _alive_regions(units, threshold, alive, block_rows)
    return _tile_pairs(regions, threshold, emit, "row_id bigint", alive=True).distinct()


def all_pairs(units: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every ``(i, j, sim)`` with ``i < j``. Nothing is below a threshold here, so there are no regions to tell apart:
    rows are dealt into blocks by hash, and every pair of blocks is a tile."""
    blocks = max(1, math.ceil(units.count() / block_rows))
    regions = _Regions(units.select("row_id", "unit", F.lit(0).alias("region")), [(0, 0, blocks, blocks)])

    def emit(ids, i, j, sim, _) -> pa.Table:
        return pa.table({"i": ids[i], "j": ids[j], "sim": sim})

    return _tile_pairs(regions, None, emit, PAIR_SCHEMA)


def similarity_pairs(units: DataFrame, threshold: float | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The similarity matrix in long form: symmetric, diagonal included. All of it, or with a ``threshold`` the entries
    that reach it."""
    upper = all_pairs(units, block_rows) if threshold is None else pairs_above(units, threshold, block_rows=block_rows)
    mirrored = upper.select(
        F.explode(
            F.array(
                F.struct(F.col("i").alias("i"), F.col("j").alias("j"), F.col("sim").alias("sim")),
                F.struct(F.col("j").alias("i"), F.col("i").alias("j"), F.col("sim").alias("sim")),
            )
        ).alias("p")
    ).select("p.*")
    own = units if threshold is None else units.where(F.col("self_sim") >= threshold)
    diagonal = own.select(F.col("row_id").alias("i"), F.col("row_id").alias("j"), F.col("self_sim").alias("sim"))
    return mirrored.unionByName(diagonal)


def nearest_reference(
    rows: DataFrame,
    references: DataFrame,
    vector: str = "embedding",
    reference_vector: str = "embedding",
    block_values: int = REFERENCE_VALUES,
) -> DataFrame:
    """Adds ``similarity_score`` and ``most_similar_idx``: the best cosine over all ``references`` (keyed by ``idx``),
    in the first place by the cosine to twelve digits, then the lowest index.

    The references are written as blocks of about ``block_values`` numbers. Every task reads them one after the other
    and keeps its rows' best: rows never move, and a task holds one block and a bounded piece of products, whatever
    the number of references. Columns of ``rows`` pass through the task, so give it only those needed.
    """
    spark = rows.sparkSession
    refs = references.select("idx", F.col(reference_vector).cast("array<double>").alias("v"))
    shape = refs.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    if shape.n == 0:
        raise ValueError("nearest_reference needs at least one reference row")
    blocks = max(1, math.ceil(shape.n * shape.d / block_values))
    folder = stage_path(spark)
    dealt = refs.withColumn("block", F.pmod(F.xxhash64("idx"), F.lit(blocks)).cast("int"))
    dealt.repartition(blocks, "block").write.partitionBy("block").parquet(folder)
    there = sorted(r.block for r in spark.read.parquet(folder).select("block").distinct().collect())

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.bounded(batches, vector, most=BATCH_VALUES):
            units = arrays.unit_rows(arrays.matrix(batch.column(vector)))
            score, at = np.full(len(units), -np.inf), np.zeros(len(units), np.int32)
            for block in there if len(units) else ():
                idx, unit = _reference_block(folder, block)
                step = max(1, BATCH_VALUES // len(idx))
                for i in range(0, len(units), step):
                    sims = units[i : i + step] @ unit.T
                    first = np.round(sims, 12).argmax(axis=1)
                    own, found = sims[np.arange(len(sims)), first], idx[first]
                    ahead, tie = np.round(own, 12) - np.round(score[i : i + step], 12), found < at[i : i + step]
                    better = (ahead > 0) | ((ahead == 0) & tie)
                    score[i : i + step] = np.where(better, own, score[i : i + step])
                    at[i : i + step] = np.where(better, found, at[i : i + step])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(score), pa.array(at)],
                names=[*batch.schema.names, "similarity_score", "most_similar_idx"],
            )

    return rows.mapInArrow(best, extended(rows, "similarity_score double, most_similar_idx int"))


@lru_cache(1)
def _reference_block(folder: str, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes, ascending, and unit vectors of one written block."""
    store, place = fs.FileSystem.from_uri(folder)
    table = parquet.read_table(f"{place}/block={block}", filesystem=store, partitioning=None).sort_by("idx")
    return table.column("idx").to_numpy().astype(np.int32), arrays.unit_rows(arrays.matrix(table.column("v")))
