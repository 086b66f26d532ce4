"""SimHash near-duplicates, linked by meet-in-the-middle ball hashing.

A text's fingerprint has 64 bits: bit j is 1 where more than half of its shingle hashes have bit j set. Shingles are
``size`` consecutive words, repeats included, space-joined (a text of fewer words is one shingle of all of them); words
are runs between ASCII blanks ``\\x20 \\x09-\\x0D``, with A-Z in lower case; hashes are XXH64 of the UTF-8 bytes with
seed 42, unsigned. A null or blank text has no shingles and fingerprint 0, and links like any other fingerprint.

Two fingerprints link when they differ in at most ``radius`` bits. Copies are folded first: one row per distinct
fingerprint, named by its smallest id. Each such row then emits every *variant* within half the radius (rounded up) of
itself (65 for radius 1 or 2), and rows meet on equal variants in a shuffle: two fingerprints
at distance d <= radius share the variant that takes half of their differing bits from each. A variant is shared by
at most as many distinct fingerprints as lie within that half radius of it (65), so no group grows with the data and
a group of thousands of copies is one row here. Pairs met are verified by their true distance, and only a star (the
group's smallest member to each other one) is kept, which connects the same rows as all pairs. Components are then
found by rounds of joins on the edges; ``component_id`` is the smallest id reachable, the row's own included.

Rows whose id is null get a fingerprint but no component (null): they can't be named. Other columns of the input are
dropped; names of the input never clash with the ones made here, which are built from the input's own. Empty tables
give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siftwatch.llm.jaccard import components
from siftwatch.llm.texts import lower_words, utf8
from siftwatch.operators.skew import salted_join
from siftwatch.staging import stage

SIZE = 3
RADIUS = 2
SEED = 42
#: Shingle hashes summed in one NumPy step; bounds a task's memory to about 80 bytes for each of them.
CHUNK = 1 << 19


def shingles(words: list[bytes], size: int = SIZE) -> list[bytes]:
    """All runs of ``size`` words, repeats included; fewer words give one shingle of them all, none give none."""
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]


def fingerprint_batch(texts: list[bytes], size: int = SIZE) -> np.ndarray:
    """Fingerprints (uint64) of UTF-8 texts."""
    import xxhash

    h64 = xxhash.xxh64_intdigest
    out = np.zeros(len(texts), dtype=np.uint64)
    hashes, owners, held = [], [], 0

    def flush():
        nonlocal hashes, owners, held
        if not hashes:
            return
        h = np.fromiter(hashes, dtype=np.uint64, count=len(hashes))
        who = np.asarray(owners, dtype=np.int64)
        starts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        for doc, count in zip(who[starts], ones):  # a text cut between two chunks is summed over both
            carried[doc] = carried.get(doc, 0) + count
        hashes, owners, held = [], [], 0

    carried: dict[int, np.ndarray] = {}
    sizes = np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        sh = shingles(lower_words(text), size)
        sizes[i] = len(sh)
        hashes.extend(h64(s, SEED) for s in sh)
        owners.extend([i] * len(sh))
        held += len(sh)
        if held >= CHUNK:
            flush()
    flush()
    weights = (np.uint64(1) << np.arange(64, dtype=np.uint64))
    for doc, count in carried.items():
        out[doc] = np.bitwise_or.reduce(np.where(2 * count > sizes[doc], weights, np.uint64(0)))
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """(id, fp long): the fingerprint of every row's whole text, its 64 bits as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def batches(parts):
        for b in parts:
            fp = fingerprint_batch(utf8(b.column(1)), size).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(batches, f"id {kind}, fp long")


def variants_of(radius: int) -> str:
    """SQL of all fingerprints within half of ``radius`` (rounded up) bits of ``fp``, ``fp`` itself first."""
    half = -(-radius // 2)
    if half == 0:
        return "array(fp)"
    if half == 1:
        return "concat(array(fp), transform(sequence(0, 63), j -> fp ^ shiftleft(1L, j)))"
    raise ValueError("a radius above 2 emits too many variants for this method")


def links(fps: DataFrame, radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """(fp, rep) with one row per distinct fingerprint and its smallest id, and edges (a, b) between reps whose
    fingerprints differ in at most ``radius`` bits (a star per shared variant)."""
    folded = stage(fps.where(F.col("id").isNotNull()).groupBy("fp").agg(F.min("id").alias("rep")))
    near = folded.select("rep", "fp", F.explode(F.expr(variants_of(radius))).alias("variant"))
    # at most 65 distinct fingerprints lie within one bit of a variant: the sets are bounded
    met = near.groupBy("variant").agg(F.collect_set(F.struct("rep", "fp")).alias("m")).where(F.size("m") > 1)
    star = met.select(F.array_min("m").alias("a"), F.explode("m").alias("b"))
    edges = star.where((F.col("a.rep") != F.col("b.rep")) & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= radius))
    return folded, edges.select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b")).distinct()


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, radius: int = RADIUS) -> DataFrame:
    """(id_col, fingerprint, component_id) for every row: 16 lower-case hex digits of the fingerprint, and the smallest
    id reachable by links of at most ``radius`` differing bits (null for a null id)."""
    fps = stage(fingerprints(docs, id_col, text_col, size))
    folded, edges = links(fps, radius)
    labels = components(edges)
    named = stage(folded.join(labels, folded.rep == labels.v, "left").select("fp", F.coalesce("root", "rep").alias("component_id")))
    joined = salted_join(fps.where(F.col("id").isNotNull()), named, "fp", spread="id")
    out = joined.unionByName(fps.where(F.col("id").isNull()).withColumn("component_id", F.lit(None).cast(fps.schema["id"].dataType)))
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return out.select(F.col("id").alias(id_col), hexed.alias("fingerprint"), "component_id")
