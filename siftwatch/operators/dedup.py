"""First-wins near-duplicate removal.

Rows are taken in ``row_id`` order; a row that survives removes every later row at or above the threshold, a removed
row removes nothing. Exact copies are folded first: the earliest copy stands for all, the others are removed with it
or because of it, and none of them ever removes anything. So copies cost one aggregate, however many there are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from siftwatch.operators import simjoin
from siftwatch.operators.graph import first_wins
from siftwatch.operators.skew import ROWS_PER_SALT, renumber, salted_join
from siftwatch.staging import stage

THRESHOLD = 0.85
# Smallest neighbours a row reports per tile; rows with more are looked at again if those all turn out removed.
NEIGHBOURS_PER_TILE = 64
# Rows decided among themselves at first.
PART_ROWS = 8192


@dataclass(frozen=True)
class Duplicates:
    """``removed``: the row ids to drop. ``pairs``: ``(i, j, sim)`` of every survivor and each removed row it matches."""

    removed: DataFrame
    pairs: DataFrame


def check_threshold(threshold: float) -> None:
    if not 0.0 < threshold <= 1.0:
        raise ValueError("the similarity threshold must be in (0, 1]")


def fold_copies(rows: DataFrame, key) -> tuple[DataFrame, DataFrame]:
    """``(leaders, copies)`` of a table keyed by ``row_id``.

    ``leaders`` holds the lowest ``row_id`` per key; ``copies`` maps every other row to its leader
    ``(row_id, leader)``.
    """
    keyed = stage(rows.select("row_id", key.alias("copy_key")))
    leaders = keyed.groupBy("copy_key").agg(F.min("row_id").alias("leader"), F.count(F.lit(1)).alias("n"))
    groups = leaders.where(F.col("n") > 1).select("copy_key", "leader")
    copies = salted_join(keyed, groups, "copy_key", spread="row_id", most_per_key=keyed.count())
    return (
        leaders.select(F.col("leader").alias("row_id")),
        copies.where(F.col("row_id") != F.col("leader")).select("row_id", "leader"),
    )


#: Rounds of ``resolve`` before the rest is decided per connected component.
ROUNDS_BEFORE_COMPONENTS = 4


def resolve(
    edges: DataFrame,
    undecided: DataFrame | None = None,
    rows_per_salt: int = ROWS_PER_SALT,
    max_rounds: int | None = None,
) -> DataFrame:
    """Ids removed by first-wins on the graph ``edges (i, j)``, ``i < j``, a written table.

    Every round takes the rows that no remaining smaller row matches (they survive) and removes all rows they match;
    edges at removed rows disappear, and with them the survivors. Without ``max_rounds`` the number of rounds is the
    longest chain of decisions. After ``max_rounds`` rounds what is left (a graph of undecided rows only) is decided
    per connected component (``graph.first_wins``), in rounds logarithmic in its longest path. Rows in ``undecided``
    are never taken for survivors.
    """
    spark = edges.sparkSession
    left = edges.select("i", "j")
    rounds: list[DataFrame] = []
    while True:
        n = left.count()
        if n == 0:
            break
        if max_rounds is not None and len(rounds) >= max_rounds:
            rounds.append(stage(first_wins(left, undecided, fallback=resolve).select(F.col("row_id").alias("j"))))
            break
        roots = left.select("i").distinct().join(left.select(F.col("j").alias("i")).distinct(), "i", "left_anti")
        if undecided is not None:
            roots = roots.join(undecided.select(F.col("row_id").alias("i")), "i", "left_anti")
        hit = salted_join(left, roots, "i", "left_semi", rows_per_salt, spread="j", most_per_key=n)
        dead = stage(hit.select("j").distinct())
        if dead.isEmpty():
            break
        rounds.append(dead)
        rest = salted_join(left, dead, "j", "left_anti", rows_per_salt, spread="i", most_per_key=n)
        rest = salted_join(rest, dead.select(F.col("j").alias("i")), "i", "left_anti", rows_per_salt, "j", n)
        left = stage(rest.select("i", "j"))
    out = spark.createDataFrame([], "row_id bigint")
    for dead in rounds:
        out = out.unionByName(dead.select(F.col("j").alias("row_id")))
    return out


def with_copies(removed: DataFrame, pairs: DataFrame, copies: DataFrame, self_sims: DataFrame) -> Duplicates:
    """Spread the decisions on leaders to their copies.

    A copy of a removed leader matches the same survivors as the leader; a copy of a survivor matches that survivor.
    """
    n = copies.count()
    by_leader = copies.select("row_id", F.col("leader").alias("j"))
    inherited = salted_join(by_leader, pairs, "j", spread="row_id", most_per_key=n).select(
        "i", F.col("row_id").alias("j"), "sim"
    )
    surviving = salted_join(
        copies, removed.select(F.col("row_id").alias("leader")), "leader", "left_anti", spread="row_id", most_per_key=n
    )
    own = salted_join(
        surviving, self_sims.withColumnRenamed("row_id", "leader"), "leader", spread="row_id", most_per_key=n
    ).select(F.col("leader").alias("i"), F.col("row_id").alias("j"), F.col("self_sim").alias("sim"))
    return Duplicates(
        removed.select("row_id").unionByName(copies.select("row_id")),
        pairs.select("i", "j", "sim").unionByName(inherited).unionByName(own),
    )


def _decided(live: DataFrame, threshold: float, neighbours: int, block_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """``(row_id)`` removed among ``live``, and all its pairs if one join gave them whole."""
    removed, complete = None, None
    while True:
        edges = stage(simjoin.first_neighbours(live, threshold, neighbours, block_rows))
        cut = edges.where("cut").select(F.col("j").alias("row_id")).distinct()
        dead = stage(resolve(edges, undecided=cut, max_rounds=ROUNDS_BEFORE_COMPONENTS))
        removed = dead if removed is None else removed.unionByName(dead)
        if removed is dead and edges.where("cut").isEmpty():
            complete = edges
        if cut.join(dead, "row_id", "left_anti").isEmpty():
            return removed, complete
        live = stage(live.join(dead, "row_id", "left_anti"))


def find_duplicates(
    df: DataFrame,
    vector: str = "embedding",
    threshold: float = THRESHOLD,
    neighbours: int = NEIGHBOURS_PER_TILE,
    block_rows: int = simjoin.BLOCK_ROWS,
    part_rows: int = PART_ROWS,
) -> Duplicates:
    """Duplicates by the cosine of a dense vector column; exact, whatever the group sizes.

    Rows report a bounded number of their smallest neighbours. Where all of those were removed and there were more,
    the decision is left open and the join runs again on what is still there. Of more than ``part_rows`` rows the
    first so many are decided among themselves, their survivors remove what they match of the rest, and so on with
    twice as many of what is left: pairs are only formed among rows that no earlier survivor has removed.
    """
    check_threshold(threshold)
    # Similarity to anything is at most the root of the self-similarity times one: shorter vectors match nothing.
    units = stage(
        simjoin.unit_vectors(df, vector).where(F.sqrt("self_sim") >= threshold)
    )
    # Vectors so short that not even their copies match are not folded.
    folds = F.when(F.col("self_sim") >= threshold, F.lit(None).cast("bigint")).otherwise(F.col("row_id"))
    leaders, copies = fold_copies(units, F.struct(simjoin.copy_key("unit").alias("v"), folds.alias("own")))
    copies = stage(copies)
    graph = stage(units.join(leaders, "row_id"))

    live, removed, complete = graph, None, None
    while True:
        n = live.count()
        last = None if n <= part_rows else live.approxQuantile("row_id", [part_rows / n], 0.2 * part_rows / n)[0]
        part = live if last is None else live.where(F.col("row_id") <= int(last))
        dead, edges = _decided(part, threshold, neighbours, block_rows)
        complete = edges if removed is None and last is None else None
        removed = dead if removed is None else removed.unionByName(dead)
        if last is None:
            break
        later = live.where(F.col("row_id") > int(last)).withColumn("alive", F.lit(False))
        survivors = part.join(dead, "row_id", "left_anti").withColumn("alive", F.lit(True))
        hit = stage(simjoin.matched_rows(survivors.unionByName(later), threshold, block_rows=block_rows))
        removed = removed.unionByName(hit)
        live = stage(later.drop("alive").join(hit, "row_id", "left_anti"))
        part_rows *= 2
    if complete is not None:
        pairs = salted_join(
            complete.select("i", "j", "sim"), removed.select(F.col("row_id").alias("i")), "i", "left_anti", spread="j"
        )
    else:
        flags = graph.join(removed.withColumn("gone", F.lit(True)), "row_id", "left")
        flags = flags.withColumn("alive", F.col("gone").isNull())
        pairs = simjoin.survivor_pairs(flags, threshold, block_rows=block_rows)
    return with_copies(removed, stage(pairs), copies, graph.select("row_id", "self_sim"))


def clean(df: DataFrame, removed: DataFrame, renumber_rows: bool = False) -> DataFrame:
    """The table without the removed rows; on request with dense new row numbers in the old order."""
    kept = df.join(removed, "row_id", "left_anti")
    if not renumber_rows:
        return kept
    return renumber(kept, "row_id").drop("row_id").withColumnRenamed("new_row_id", "row_id")


def duplicate_report(pairs: DataFrame, names: DataFrame, ordered: bool = True) -> DataFrame:
    """One row per survivor and removed row, with the first 50 characters of both names."""
    short = names.select("row_id", F.substring("name", 1, 50).alias("name"))
    pairs = stage(pairs)
    n = pairs.count()
    named = salted_join(
        pairs, short.select(F.col("row_id").alias("i"), F.col("name").alias("original_name")), "i", spread="j", most_per_key=n
    )
    named = salted_join(
        named, short.select(F.col("row_id").alias("j"), F.col("name").alias("duplicate_name")), "j", spread="i", most_per_key=n
    )
    report = named.select(
        F.col("i").alias("original_idx"),
        F.col("j").alias("duplicate_idx"),
        F.col("sim").alias("similarity"),
        "original_name",
        "duplicate_name",
    )
    return report.orderBy("original_idx", "duplicate_idx") if ordered else report


def duplicate_samples(report: DataFrame, n: int = 3) -> DataFrame:
    return report.orderBy("original_idx", "duplicate_idx").limit(n)


def dedup_summary(df: DataFrame, removed: DataFrame) -> DataFrame:
    """Rows before and after, rows removed, and the share removed in percent."""
    counts = df.select(F.lit(0).alias("gone")).unionByName(removed.select(F.lit(1).alias("gone")))
    totals = counts.agg(F.count_if(F.col("gone") == 0).alias("original"), F.sum("gone").alias("removed"))
    removed_n = F.coalesce("removed", F.lit(0)).cast("bigint")
    return totals.select(
        "original",
        removed_n.alias("removed"),
        (F.col("original") - removed_n).alias("unique_rows"),
        (F.try_divide(removed_n.cast("double"), F.col("original").cast("double")) * 100.0).alias("rate_percent"),
    )
