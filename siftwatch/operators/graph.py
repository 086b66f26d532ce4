"""Connected components of an edge table, and first-wins decided per component inside tasks.

Components follow the alternating large-star / small-star rounds of Kiveris et al. ("Connected Components in MapReduce
and Beyond", 2014). Large-star links every neighbour above a vertex to the smallest vertex of its neighbourhood;
small-star links a vertex and its smaller neighbours to the smallest of them. The graph stays connected the same way,
each vertex keeps pointing lower, and the rounds end when every component is a star around its smallest vertex: the
number of rounds grows with the logarithm of the longest path, not with its length. Each half-step is one aggregate
(the smallest neighbour, which combines map-side) and one join, salted where a vertex has many neighbours.

First-wins (rows in ascending order; a surviving row removes all later rows it is linked to, a removed row removes
nothing) only depends on the rows of one component. A component of at most ``LOCAL_EDGES`` edges is therefore decided
by one task in a single ascending pass; the rest, which no task should hold, go through the rounds of
``dedup.resolve``, which are exact at any size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from siftwatch.operators.skew import salted_join
from siftwatch.staging import stage

#: Edges of a component that one task decides at once.
LOCAL_EDGES = 2_000_000


def _least_neighbour(half: DataFrame) -> DataFrame:
    """(u, m): the smallest of u and its listed neighbours v, per u of ``half (u, v)``."""
    return half.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = _least_neighbour(both)
    met = salted_join(both.where(F.col("v") > F.col("u")), low, "u", spread="v")
    return met.select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("u") != F.col("v"))
    low = _least_neighbour(down)
    met = salted_join(down, low, "u", spread="v")
    linked = met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return linked.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, a: str = "i", b: str = "j") -> tuple[DataFrame, int]:
    """``(v, root)`` for every vertex of ``edges``: the smallest vertex of its connected component; and the number of
    rounds taken. Vertices without edges don't appear."""
    current = stage(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a") != F.col("b")).distinct())
    rounds = 0
    while True:
        rounds += 1
        grown = stage(_small_star(stage(_large_star(current))))
        if grown.exceptAll(current).isEmpty() and current.exceptAll(grown).isEmpty():
            break
        current = grown
    # every component is now a star around its smallest vertex
    stars = current.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("root"))
    roots = current.select(F.least("a", "b").alias("v")).distinct().withColumn("root", F.col("v"))
    return stage(stars.unionByName(roots).groupBy("v").agg(F.min("root").alias("root"))), rounds


def first_wins_local(edges: pd.DataFrame, undecided: set | None = None) -> list[int]:
    """Rows removed by first-wins on one component's edges (i < j). Rows in ``undecided`` never survive: a row they
    reach, and that no survivor removes, stays undecided as well."""
    i, j = edges["i"].to_numpy(np.int64), edges["j"].to_numpy(np.int64)
    order = np.lexsort((i, j))
    i, j = i[order], j[order]
    undecided = undecided or set()
    state: dict[int, int] = {}  # 1 survives, 0 removed, 2 undecided; rows without a smaller link survive
    starts = np.flatnonzero(np.r_[True, j[1:] != j[:-1]]) if len(j) else np.zeros(0, np.int64)
    ends = np.r_[starts[1:], len(j)]
    for s, e in zip(starts.tolist(), ends.tolist()):
        row = int(j[s])
        smaller = [state.get(x, 2 if x in undecided else 1) for x in i[s:e].tolist()]
        if 1 in smaller:
            state[row] = 0
        elif row in undecided or 2 in smaller:
            state[row] = 2
        else:
            state[row] = 1
    return [r for r, s in state.items() if s == 0]


def first_wins(edges: DataFrame, undecided: DataFrame | None = None, local_edges: int = LOCAL_EDGES, fallback=None) -> DataFrame:
    """``(row_id)`` removed by first-wins on ``edges (i, j)``, ``i < j``. Components of at most ``local_edges`` edges
    are decided inside one task each; ``fallback(edges, undecided)`` decides the edges of larger ones."""
    labels, _ = components(edges)
    e = stage(salted_join(edges.select("i", "j"), labels.select(F.col("v").alias("i"), "root"), "i", spread="j"))
    sizes = e.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    big = stage(sizes.where(F.col("n") > local_edges).select("root"))
    small = e.join(F.broadcast(big), "root", "left_anti") if big.limit(10_001).count() <= 10_000 else e.join(big, "root", "left_anti")
    stuck = undecided.select(F.col("row_id").alias("j"), F.lit(True).alias("open")) if undecided is not None else None
    if stuck is not None:
        open_i = undecided.select(F.col("row_id").alias("i"), F.lit(True).alias("open_i"))
        small = small.join(stuck, "j", "left").join(open_i, "i", "left")
    else:
        small = small.withColumn("open", F.lit(None).cast("boolean")).withColumn("open_i", F.lit(None).cast("boolean"))

    def decide(part: pd.DataFrame) -> pd.DataFrame:
        held = set(part.loc[part["open"].fillna(False).astype(bool), "j"].tolist()) | set(part.loc[part["open_i"].fillna(False).astype(bool), "i"].tolist())
        return pd.DataFrame({"row_id": np.array(first_wins_local(part, held), dtype=np.int64)})

    removed = small.select("root", "i", "j", "open", "open_i").groupBy("root").applyInPandas(decide, "row_id bigint")
    if fallback is not None and not big.isEmpty():
        removed = removed.unionByName(fallback(stage(e.join(big, "root").select("i", "j")), undecided))
    return removed
