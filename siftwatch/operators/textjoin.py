"""Exact cosine similarity join and first-wins removal on sparse TF-IDF vectors, by prefix filtering.

Tokens are keyed by 64 bits, so no two words share a weight and nothing has a fixed width; their document
frequencies are a dictionary in sorted shards, in which tasks look up their rows' terms. Every unit vector orders its terms from the rarest to
the most common. Its prefix is the shortest run of terms after which the rest has a norm below the threshold: two
vectors at or above the threshold must share a prefix term, since what lies outside cannot reach it. So only rows that
share a rare term are ever compared, and the bound is exact: nothing at or above the threshold is missed.

Lists of near copies are thinned before pairs are formed (``leader_rounds``): a row that comes first in all its
prefix lists surely survives, is compared once with the members of those lists, and removes what it matches. That is
linear in the lists, also when a third of all rows are near copies of each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siftwatch.functions import arrays
from siftwatch.operators import dedup, sparsetiles, vectorize
from siftwatch.operators.skew import lookup_join, salted_join
from siftwatch.staging import stage, stage_path

# Room for rounding in the bounds; only ever lets more candidates through.
SLACK = 1e-9
# Leader rounds go on while the lists hold more than this many candidate pairs per entry ...
PAIRS_PER_ENTRY = 32
# ... and each of them takes away at least this share of the pairs.
WORTHWHILE = 0.2
# Rows of one list in one task of the pair join.
LIST_ROWS = 4096
# The prefix runs on until the rest is this far below the threshold. Rows that share a rare bucket by chance then
# fail the cheap bound, which saves far more vector traffic than the longer lists cost. The extension ends at
# buckets of more rows than EXTEND_ROWS, so it adds no long list.
MARGIN = 0.05
EXTEND_ROWS = 512
# Terms (16 bytes each) of one shard of the dictionary; a task holds a few shards at a time.
BROADCAST_TERMS = 1_000_000
UNIT_SCHEMA = (
    "row_id bigint, idx array<int>, tf array<int>, df array<int>, n_rows bigint, prefix_at array<int>, rest double, "
    "self_sim double"
)


def frequencies(terms: DataFrame) -> DataFrame:
    """The term dictionary: ``(term, df)``, one row per distinct 64-bit token key."""
    return terms.select(F.explode("idx").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def one_row_per_id(terms: DataFrame) -> DataFrame:
    """``terms`` with the rows of a repeated id merged into one, which then lists a term as often as they do. Only
    those rows are moved."""
    counts = terms.groupBy("row_id").agg(F.count(F.lit(1)).alias("n"))
    again = stage(counts.where("n > 1").select(F.col("row_id").alias("_again")))
    if again.isEmpty():
        return terms
    same = F.col("row_id").eqNullSafe(F.col("_again"))
    entries = terms.join(again, same, "left_semi").select("row_id", F.explode(F.arrays_zip("idx", "tf")).alias("e"))
    merged = entries.groupBy("row_id").agg(F.sort_array(F.collect_list("e")).alias("e"))
    alone = terms.join(again, same, "left_anti").select("row_id", "idx", "tf")
    return alone.unionByName(merged.select("row_id", F.col("e.idx").alias("idx"), F.col("e.tf").alias("tf")))


@lru_cache(8)
def _shard(folder: str, number: int) -> tuple[np.ndarray, np.ndarray]:
    table = sparsetiles.part(folder, "shard", number)
    if table is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    table = table.sort_by("term")
    return table.column("term").to_numpy(), table.column("df").to_numpy()


@dataclass(frozen=True)
class Dictionary:
    """Terms with their frequencies, written once in shards of about ``BROADCAST_TERMS`` terms. ``before``: how many
    terms the shards before each hold, so that a term's place in its shard gives it a number of its own."""

    folder: str
    shards: int
    before: tuple[int, ...]

    def look_up(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``(row_id, idx, tf, df, number)`` of rows ``(row_id, idx, tf)``. A task goes through one shard after the
        other, so no entry is shuffled and a task's memory is bounded whatever the number of terms."""
        before = np.array(self.before, np.int64)
        for batch in arrays.bounded(batches, 1, most=vectorize.BATCH_VALUES):
            row, idx = arrays.ragged(batch.column(1))
            _, tf = arrays.ragged(batch.column(2))
            keys, code = np.unique(idx, return_inverse=True)
            df, number = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int32)
            own = (keys.view(np.uint64) >> np.uint64(32)) % np.uint64(self.shards)
            for shard in np.unique(own).tolist():
                at = np.flatnonzero(own == shard)
                term, n = _shard(self.folder, shard)
                place = np.minimum(np.searchsorted(term, keys[at]), max(len(term) - 1, 0))
                if len(term):
                    df[at] = np.where(term[place] == keys[at], n[place], 0)
                    number[at] = before[shard] + place
            known = df[code] > 0
            row, idx, tf, code = row[known], idx[known], tf[known], code[known]
            lengths = np.bincount(row, minlength=batch.num_rows)
            columns = [batch.column(0), *(arrays.lists(x, lengths) for x in (idx, tf.astype(np.int32), df[code], number[code]))]
            out = pa.RecordBatch.from_arrays(columns, names=["row_id", "idx", "tf", "df", "number"])
            yield out.filter(pa.array(lengths > 0))


def written(dictionary: DataFrame) -> Dictionary:
    folder, shards = stage_path(dictionary.sparkSession), 1 + dictionary.count() // BROADCAST_TERMS
    dealt = dictionary.select("term", "df", (F.shiftrightunsigned("term", 32) % shards).cast("int").alias("shard"))
    dealt.repartition(shards, "shard").write.partitionBy("shard").parquet(folder)
    sizes = {r.shard: r.n for r in dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per shard
    before = np.cumsum([0] + [sizes.get(k, 0) for k in range(shards)])
    return Dictionary(folder, shards, tuple(before.tolist()))


def with_frequencies(terms: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``(row_id, idx, tf, df)``: every row's terms (ascending) with their document frequencies."""
    found = written(dictionary)
    rows = one_row_per_id(terms.select("row_id", "idx", "tf"))
    schema = "row_id bigint, idx array<bigint>, tf array<int>, df array<bigint>, number array<int>"
    return rows.mapInArrow(found.look_up, schema).drop("number")


def sparse_units(terms: DataFrame, dictionary: DataFrame, n_rows: int, threshold: float) -> DataFrame:
    """Unit vectors with their prefix: narrow, one pass over the terms, which are looked up on the way. Rows without tokens are absent (they
    match nothing). ``idx`` holds the terms' numbers; values follow from ``tf``, ``df`` and ``n_rows``
    (``sparsetiles.weights``), which take a fraction of their room, and go down. ``prefix_at`` has the places of the prefix's entries,
    rarest first, equal frequencies by key; ``rest`` is the norm of what is outside the prefix."""

    words = written(dictionary)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays.release()
        for batch in words.look_up(batches):
            n = batch.num_rows
            row, idx = arrays.ragged(batch.column(1))
            tf, df, number = (arrays.ragged(batch.column(k))[1] for k in (2, 3, 4))
            every = np.full(n, n_rows, np.int64)
            val = sparsetiles.weights(row, tf, df, every)
            # Heaviest first, but for merged rows, whose repeated terms stay side by side.
            merged = np.zeros(n, bool)
            merged[row[1:][(idx[1:] == idx[:-1]) & (row[1:] == row[:-1])]] = True
            heavy = np.lexsort((np.where(merged[row], 0.0, -val), row))
            idx, tf, df, number, val = (x[heavy] for x in (idx, tf, df, number, val))
            lengths = np.bincount(row, minlength=n)
            own = np.bincount(row, weights=val * val, minlength=n)
            order = np.lexsort((idx, df, row))
            square = (val * val)[order]
            # Squared norm of each entry and everything more common than it, within its row.
            total = np.cumsum(square)
            row_end = np.cumsum(lengths)
            end_total = np.concatenate(([0.0], total))[row_end]
            tail = end_total[row] - total + square
            needed = tail >= (threshold - SLACK) ** 2
            # Frequencies ascend along the order, so what is kept is still one run from the rarest term on.
            inside = needed | ((tail >= (threshold - MARGIN) ** 2) & (df[order] <= EXTEND_ROWS))
            head = order[inside]
            rest = np.sqrt(np.maximum(own - np.bincount(row[inside], weights=square[inside], minlength=n), 0.0))
            head_n = np.bincount(row[inside], minlength=n)
            first = np.cumsum(lengths) - lengths
            out = pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(arrays.lists(x.astype(np.int32), lengths) for x in (number, tf, df)),
                    pa.array(every),
                    arrays.lists((head - first[row[head]]).astype(np.int32), head_n),
                    pa.array(rest),
                    pa.array(own),
                ],
                names=["row_id", "idx", "tf", "df", "n_rows", "prefix_at", "rest", "self_sim"],
            )
            yield out.filter(pa.array(head_n > 0))
        _shard.cache_clear()
        arrays.release()

    return one_row_per_id(terms.select("row_id", "idx", "tf")).mapInArrow(build, UNIT_SCHEMA)


def units_of(df: DataFrame, text: str, threshold: float, terms: DataFrame | None = None) -> DataFrame:
    """The unit vectors of a text column: tokens keyed by 64 bits, frequencies from the written dictionary. Terms and
    dictionary are written; vectors are worked out from them in one narrow pass wherever they are read, since they take
    several times the room of the terms."""
    terms = terms if terms is not None else stage(vectorize.keyed_terms(df, text))
    return sparse_units(terms, stage(frequencies(terms)), terms.count(), threshold)


def postings(units: DataFrame) -> DataFrame:
    """``(bucket, row_id, w, rest)``: one entry per prefix bucket of a row."""

    def weight(tf, df):
        return tf * F.log((F.col("n_rows") + 1) / (df + 1))

    norm = F.sqrt(F.aggregate(F.zip_with("tf", "df", lambda t, d: weight(t, d) * weight(t, d)), F.lit(0.0), lambda acc, x: acc + x))
    entry = F.transform(
        "prefix_at",
        lambda at: F.struct(
            F.get("idx", at).alias("bucket"), (weight(F.get("tf", at), F.get("df", at)) / (F.col("norm") + 1e-8)).alias("w")
        ),
    )
    entries = units.withColumn("norm", norm).select("row_id", "rest", F.explode(entry).alias("e"))
    return entries.select("e.bucket", "row_id", "e.w", "rest")


def _reaching(met: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``(i, j)`` of ``met (i, j, wi, wj, ri, rj)`` whose shared prefix part plus the most the rest can add
    reaches the threshold. Beyond the shorter prefix lies at most that row's rest times what the other row has left
    besides the shared buckets."""
    shared = met.groupBy("i", "j").agg(
        F.sum(F.col("wi") * F.col("wj")).alias("acc"),
        F.sum(F.col("wi") * F.col("wi")).alias("si"),
        F.sum(F.col("wj") * F.col("wj")).alias("sj"),
        F.first("ri").alias("ri"),
        F.first("rj").alias("rj"),
    )

    def left(used):
        return F.sqrt(F.greatest(F.lit(1.0) - F.col(used), F.lit(0.0)))

    most = F.col("acc") + F.greatest(F.col("ri") * left("sj"), F.col("rj") * left("si"))
    return shared.where(most >= threshold - SLACK).select("i", "j")


def candidate_pairs(
    entries: DataFrame, threshold: float, list_rows: int = LIST_ROWS, longest: int | None = None
) -> DataFrame:
    """Pairs ``(i, j)``, ``i < j``, that share prefix buckets and pass the cheap bound. Lists above ``list_rows``
    are cut into slices that different tasks join; ``longest`` bounds the list lengths when it is known. It moves every
    meeting, so the joins over whole corpora meet in ``sparsetiles`` instead."""
    mine = entries.select("bucket", F.col("row_id").alias("i"), F.col("w").alias("wi"), F.col("rest").alias("ri"))
    other = entries.select("bucket", F.col("row_id").alias("j"), F.col("w").alias("wj"), F.col("rest").alias("rj"))
    met = salted_join(mine, other, "bucket", rows_per_salt=list_rows, spread="i", most_per_key=longest).where("i < j")
    return _reaching(met, threshold)


def pairs_above(units: DataFrame, threshold: float) -> DataFrame:
    """All ``(i, j, sim)`` at or above the threshold, exactly."""
    return stage(sparsetiles.pairs(sparsetiles.write(units), threshold))


@dataclass(frozen=True)
class Thinned:
    entries: DataFrame
    removed: list[DataFrame]
    rounds: int
    longest: int


def leader_rounds(
    units: DataFrame, threshold: float, pairs_per_entry: float = PAIRS_PER_ENTRY, blocks: sparsetiles.Blocks | None = None
) -> Thinned:
    """Decide rows that come first in all their lists, and what they remove, until the lists are short.

    A smaller row that matches row *r* shares a list with it, so a row first in every list of its own has none and
    survives. It needs no further comparison after its round, and leaves with the rows it removed. A round costs one
    comparison per list entry at most. The rounds end early when one took away too few pairs, which only leaves more
    for the pair join.
    """
    blocks = blocks or sparsetiles.write(units)
    entries, written = postings(units).select("bucket", "row_id"), False
    removed: list[DataFrame] = []
    rounds, before = 0, float("inf")
    while True:
        sizes = entries.groupBy("bucket").agg(F.count(F.lit(1)).cast("double").alias("n"))
        load = sizes.agg(
            F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"), F.sum("n").alias("n"), F.max("n").alias("longest")
        ).first()
        if not load.n or load.pairs <= pairs_per_entry * load.n or load.pairs > (1.0 - WORTHWHILE) * before:
            break
        before = load.pairs
        if not written:
            entries, written = stage(entries), True
        first = entries.groupBy("bucket").agg(F.min("row_id").alias("first"))
        leading = salted_join(entries, first, "bucket", spread="row_id")
        by_row = leading.groupBy("row_id").agg(F.bool_and(F.col("first") == F.col("row_id")).alias("leads"))
        leaders = stage(by_row.where("leads").select("row_id"))
        marked = entries.select("row_id").distinct().join(leaders.withColumn("first", F.lit(True)), "row_id", "left")
        roles = marked.withColumns({"first": F.coalesce("first", F.lit(False)), "later": F.lit(True)})
        gone = stage(sparsetiles.pairs(blocks, threshold, roles).select(F.col("j").alias("row_id")).distinct())
        removed.append(gone)
        rounds += 1
        entries = stage(entries.join(leaders, "row_id", "left_anti").join(gone, "row_id", "left_anti"))
    return Thinned(entries, removed, rounds, int(load.longest or 0))


def find_duplicates(
    df: DataFrame,
    text: str = "description",
    threshold: float = dedup.THRESHOLD,
    terms: DataFrame | None = None,
    pairs_per_entry: float = PAIRS_PER_ENTRY,
) -> dedup.Duplicates:
    """First-wins duplicates of a text column by the cosine of its TF-IDF vectors over 64-bit token keys; exact.
    ``terms``, if given, is ``vectorize.keyed_terms`` of the column. Leader rounds are taken only where rows have more
    than about ``pairs_per_entry`` matches each: chance meetings, which they don't thin, cost the pair join little."""
    dedup.check_threshold(threshold)
    units = units_of(df, text, threshold, terms)
    # Only rows that match themselves fold with their copies; the others keep a key of their own.
    own = F.when(F.col("self_sim") >= threshold, F.lit(None).cast("bigint")).otherwise(F.col("row_id"))
    key = F.struct(
        F.xxhash64("idx", "tf").alias("a"), F.xxhash64("tf", "idx", F.lit(1)).alias("b"), own.alias("own")
    )
    # Vectors are worked out once and written with all copies; from here on roles say which rows take part.
    blocks = sparsetiles.write(units.withColumn("copy", key))
    leaders, copies = dedup.fold_copies(blocks.rows(), F.col("copy"))
    copies = stage(copies)
    rows = stage(blocks.rows().select("row_id", "self_sim").join(leaders, "row_id"))
    roles = None
    if not copies.isEmpty():
        roles = rows.select("row_id", F.lit(True).alias("first"), F.lit(True).alias("later"))
    thinned = Thinned(rows, [], 0, 0)
    if sparsetiles.estimated_pairs(blocks, threshold, roles) > pairs_per_entry * blocks.n_rows:
        graph = lookup_join(blocks.rows(), copies.select("row_id"), "row_id", "left_anti", BROADCAST_TERMS)
        thinned = leader_rounds(graph, threshold, pairs_per_entry, blocks)
    if thinned.rounds:
        left = thinned.entries.select("row_id").distinct()
        roles = left.withColumns({"first": F.lit(True), "later": F.lit(True)})
    edges = stage(sparsetiles.pairs(blocks, threshold, roles))
    removed = dedup.resolve(edges, max_rounds=dedup.ROUNDS_BEFORE_COMPONENTS)
    for gone in thinned.removed:
        removed = removed.unionByName(gone)
    removed = stage(removed)
    if thinned.rounds:
        # Survivors and removed rows of different rounds can match too; the report wants them all.
        gone = removed.select("row_id", F.lit(True).alias("later"))
        marked = rows.select("row_id").join(gone, "row_id", "left").withColumn("later", F.coalesce("later", F.lit(False)))
        pairs = sparsetiles.pairs(blocks, threshold, marked.withColumn("first", ~F.col("later")))
    else:
        gone = removed.select(F.col("row_id").alias("i"))
        pairs = salted_join(edges, gone, "i", "left_anti", spread="j", most_per_key=edges.count())
    return dedup.with_copies(removed, stage(pairs), copies, rows)
