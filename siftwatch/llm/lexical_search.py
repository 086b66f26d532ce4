"""Ranked lexical search: the best documents of each query by an integer BM25-like score, found in sparse ball trees.

Terms are the maximal runs of ASCII letters and digits and of all characters above U+007F, with A-Z in lower case;
a null text has none. Over all documents, N counts those with a term, L all their terms; per document, n counts its
terms and tf each term's occurrences, and df counts the documents holding a term. Then, in 64-bit integers (``div``
rounds down) and the weight in doubles::

    w(t)    = floor(1000 * ln((2N + 2) / (2 df(t) + 1)))
    m(d)    = 25 + (75 * n(d) * N) div L
    v(d, t) = (10^9 * tf(d, t)) div (1000 * tf(d, t) + 8 * m(d))
    score   = sum over the query's terms, repeats included, of w(t) * v(d, t)

so that a score is the inner product of a query vector (w times the term's count in the query) and a sparse document
vector v. Counts, weights and vectors are Spark aggregates and joins; only the terms that some query holds are kept
past the first pass, so the work beyond that pass grows with (queries x matching postings), not with the vocabulary.

Search: queries are dealt into blocks, documents (those with a term of a block) into shards by a hash of their id, and
each (block, shard) is one task. The task builds a ball tree over its documents' vectors, restricted to the block's
terms: each node holds the centroid c of its documents and the radius r of the ball around it, split in two at the
median of the projections on the line between two far-apart members. A query walks the tree best-first by the bound
q.c + |q| r, raised by a margin that covers floating-point rounding, and stops when the best bound left is below its
tenth-best exact score (equal bounds are still visited, as a smaller doc_id wins a tie). Scores at the leaves are
exact 64-bit integer sums. The ten best of every shard then meet in one window per query, ranked by score, then
ascending doc_id; only scores above 0 are kept.

Defined cases: rows with a null id are left out (counted neither in N nor L); rows sharing an id are one document
(their terms pooled); a query without terms, or whose terms no document holds, has no rows; a null query id is a query
like any other; empty tables give empty results. Other columns of the inputs are dropped first, so their names don't
matter. Very long texts are single documents like any other: their vectors have one entry per distinct query term.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from siftwatch.operators.skew import lookup_join
from siftwatch.staging import stage

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Fixed values of the ranking: the term pattern, k1 (as 1000 and 8 per mille per unit of m) and b (75 in 100).
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: What lies between terms: the complement of TERM (splitting is cheaper than extracting matches in the JVM).
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 10
#: Queries per block and documents per shard: a task holds one block's queries and one shard's vectors.
QUERIES_PER_BLOCK = 64
DOCS_PER_SHARD = 20_000
#: Documents in a leaf of the ball tree.
LEAF = 32
#: Query-term vocabularies up to this many terms are copied to every executor; larger ones are joined by a shuffle.
MAX_BROADCAST_TERMS = 2_000_000


def terms_of(text: str):
    """Column: the array of a text's terms (null text: empty)."""
    parts = F.filter(F.split(F.translate(F.col(text), UPPER, LOWER), GAP), lambda t: t != "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def doc_vectors(docs: DataFrame, vocab: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tid, v) for the vocabulary's terms, and (tid, w) for those that some document holds. ``vocab`` is
    (term, tid). One pass over the texts keeps each row's size and its occurrences of vocabulary terms."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), terms_of(text_col).alias("terms"))
    each = rows.select("doc_id", F.size("terms").alias("n"), F.posexplode_outer("terms").alias("pos", "term"))
    if vocab.limit(MAX_BROADCAST_TERMS + 1).count() <= MAX_BROADCAST_TERMS:
        marked = each.join(F.broadcast(vocab), "term", "left")
    else:
        marked = each.join(vocab, "term", "left")  # adaptive execution splits a hot term's partition
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    kept = stage(marked.where(F.col("tid").isNotNull() | first).select("doc_id", "n", first.alias("first"), "tid"))
    sizes = stage(kept.where("first").groupBy("doc_id").agg(F.sum("n").alias("n")))
    stats = sizes.agg(F.count(F.when(F.col("n") > 0, 1)).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("L"))
    big_n, big_l = stats.first()
    postings = stage(kept.where(F.col("tid").isNotNull()).groupBy("doc_id", "tid").agg(F.count(F.lit(1)).alias("tf")))
    ln = F.log((2.0 * F.lit(big_n) + 2.0) / (2.0 * F.col("df") + 1.0))
    weights = postings.groupBy("tid").agg(F.count(F.lit(1)).alias("df")).select("tid", F.floor(1000.0 * ln).cast("long").alias("w"))
    m = F.lit(25) + F.expr(f"(75L * n * {int(big_n)}L) div {max(int(big_l), 1)}L")
    v = F.expr("(1000000000L * tf) div (1000L * tf + 8L * m)")
    vectors = postings.join(sizes, "doc_id").withColumn("m", m).select("doc_id", "tid", v.alias("v"))
    return vectors, weights


class BallTree:
    """A ball tree over sparse non-negative rows given as (row, col, value) triples of ``n`` rows and ``t`` columns."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, n: int, t: int, leaf: int = LEAF):
        x = vals.astype(np.float64)
        sq = np.bincount(rows, weights=x * x, minlength=n)
        self.first, self.end, self.kids, centres, radii = [], [], [], [], []
        order = np.empty(n, dtype=np.int64)
        side_of = np.zeros(n, dtype=bool)
        stack, placed = [(np.arange(n), rows, cols, x, -1, 0)], 0
        while stack:  # each node hands its own triples down, so a level costs one pass over them
            members, r, c, v, parent, side = stack.pop()
            node = len(self.first)
            if parent >= 0:
                self.kids[parent][side] = node
            centre = np.bincount(c, weights=v, minlength=t) / len(members)
            dot = np.bincount(r, weights=v * centre[c], minlength=n)[members]
            dist = np.maximum(sq[members] - 2 * dot + centre @ centre, 0.0)
            centres.append(centre)
            radii.append(math.sqrt(dist.max()))
            self.kids.append([-1, -1])
            if len(members) <= leaf:
                self.first.append(placed)
                order[placed : placed + len(members)] = members
                placed += len(members)
                self.end.append(placed)
                continue
            self.first.append(-1)
            self.end.append(-1)
            a = members[int(np.argmax(dist))]
            da = self._dense(r, c, v, a, t)
            to_a = sq[members] - 2 * np.bincount(r, weights=v * da[c], minlength=n)[members]
            b = members[int(np.argmax(to_a))]
            direction = da - self._dense(r, c, v, b, t)
            proj = np.bincount(r, weights=v * direction[c], minlength=n)[members]
            ranked = members[np.argsort(proj, kind="stable")]
            half = len(ranked) // 2
            side_of[ranked[:half]] = False
            side_of[ranked[half:]] = True
            right = side_of[r]
            stack.append((ranked[half:], r[right], c[right], v[right], node, 1))
            stack.append((ranked[:half], r[~right], c[~right], v[~right], node, 0))
        self.order = order
        self.centres = np.array(centres)
        self.radii = np.array(radii)
        # rows in leaf order, as CSR, for exact integer scores
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.arange(n)
        by = np.lexsort((cols, rank[rows]))
        self.cols, self.vals = cols[by], vals[by].astype(np.int64)
        self.ptr = np.searchsorted(rank[rows][by], np.arange(n + 1))

    @staticmethod
    def _dense(r, c, v, row, t):
        out = np.zeros(t)
        sel = r == row
        out[c[sel]] = v[sel]
        return out

    def best(self, q_cols: np.ndarray, q_vals: np.ndarray, ids: np.ndarray, top: int = TOP) -> list[tuple[int, int]]:
        """(score, id) of the ``top`` highest exact scores above 0, ties by smaller id, best first."""
        qf = q_vals.astype(np.float64)
        bounds = self.centres[:, q_cols] @ qf + math.sqrt(qf @ qf) * self.radii
        bounds += np.abs(bounds) * 1e-9 + 1.0  # rounding of the products above can't hide a better document
        dense = np.zeros(self.centres.shape[1], dtype=np.int64)
        dense[q_cols] = q_vals
        kept: list[tuple[int, int]] = []  # min-heap of (score, -id): its head is the one to lose next
        frontier = [(-bounds[0], 0)]
        while frontier:
            neg, node = heapq.heappop(frontier)
            if len(kept) == top and -neg < kept[0][0]:
                break
            if self.first[node] < 0:
                for kid in self.kids[node]:
                    heapq.heappush(frontier, (-bounds[kid], kid))
                continue
            lo, hi = self.ptr[self.first[node]], self.ptr[self.end[node]]
            prod = self.vals[lo:hi] * dense[self.cols[lo:hi]]
            starts = self.ptr[self.first[node] : self.end[node]] - lo
            scores = np.add.reduceat(prod, starts) if hi > lo else np.zeros(0, dtype=np.int64)
            for row, score in zip(self.order[self.first[node] : self.end[node]], scores.tolist()):
                if score <= 0:
                    continue
                entry = (score, -int(ids[row]))
                if len(kept) < top:
                    heapq.heappush(kept, entry)
                elif entry > kept[0]:
                    heapq.heapreplace(kept, entry)
        return sorted(((s, -i) for s, i in kept), key=lambda e: (-e[0], e[1]))


def search_group(docs: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    """The ten best documents of one shard for each query of one block."""
    empty = pd.DataFrame({"item_id": pd.Series([], dtype="Int64"), "doc_id": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="int64")})
    if docs.empty or queries.empty:
        return empty
    terms, codes = np.unique(np.concatenate([docs["tid"].to_numpy(np.int64), queries["tid"].to_numpy(np.int64)]), return_inverse=True)
    d_cols, q_cols = codes[: len(docs)], codes[len(docs) :]
    ids, rows = np.unique(docs["doc_id"].to_numpy(dtype=np.int64), return_inverse=True)
    tree = BallTree(rows, d_cols, docs["v"].to_numpy(dtype=np.int64), len(ids), len(terms))
    out_items, out_docs, out_scores = [], [], []
    q = queries.assign(col=q_cols)
    for item, part in q.groupby("item_id", dropna=False, sort=False):
        for score, doc in tree.best(part["col"].to_numpy(), part["q"].to_numpy(dtype=np.int64), ids):
            out_items.append(None if pd.isna(item) else int(item))
            out_docs.append(doc)
            out_scores.append(score)
    if not out_items:
        return empty
    return pd.DataFrame({"item_id": pd.Series(out_items, dtype="Int64"), "doc_id": np.array(out_docs, dtype=np.int64), "score": np.array(out_scores, dtype=np.int64)})


def ranked(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``top`` best documents of every item with a score above 0."""
    qterms = items.select(F.col(item_col).cast("long").alias("item_id"), F.explode(terms_of(item_text)).alias("term"))
    qtf = stage(qterms.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("qtf")))
    # term ids: unique 64-bit numbers of a written table, so that tasks meet numbers, not strings
    vocab = stage(stage(qtf.select("term").distinct()).withColumn("tid", F.monotonically_increasing_id()))
    vectors, weights = doc_vectors(docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col)), vocab, id_col, text_col)
    queries = qtf.join(vocab, "term").join(weights, "tid").select("item_id", "tid", (F.col("w") * F.col("qtf")).alias("q"))
    n_items = queries.select("item_id").distinct().count()
    blocks = max(1, -(-n_items // QUERIES_PER_BLOCK))
    block_of = F.pmod(F.xxhash64(F.coalesce(F.col("item_id"), F.lit(-1)), F.col("item_id").isNull()), F.lit(blocks)).cast("int")
    queries = stage(queries.withColumn("block", block_of))
    block_terms = stage(queries.select("tid", "block").distinct())
    vectors = stage(vectors)
    n_docs = vectors.select("doc_id").distinct().count()
    shards = max(1, -(-n_docs // DOCS_PER_SHARD))
    dealt = lookup_join(vectors, block_terms, "tid").withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    spread = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    # one partition per (block, shard): a task holds one shard's vectors, whatever the number of shards
    tasks = blocks * shards
    found = (
        dealt.select("block", "shard", "doc_id", "tid", "v").repartition(tasks, "block", "shard")
        .groupBy("block", "shard")
        .cogroup(spread.select("block", "shard", "item_id", "tid", "q").repartition(tasks, "block", "shard").groupBy("block", "shard"))
        .applyInPandas(search_group, "item_id long, doc_id long, score long")
    )
    order = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    best = found.withColumn("rank", order).where(F.col("rank") <= top)
    return best.select(F.col("item_id").alias(item_col), F.col("rank").cast("int"), F.col("doc_id").alias(id_col), "score")
