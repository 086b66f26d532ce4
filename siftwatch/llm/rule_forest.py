"""Quality rules as statistics, and an isolation forest over them with a threshold from labelled rows.

Every text gives counts (words, symbols, repeated lines, repeated passages and the like). Two base rules reject outright;
what they leave is scored by a forest of random trees: a row that few random splits set apart is anomalous. Trees are
grown on a bounded sample of rows (``TREES`` x ``TREE_ROWS``, those with the lowest hashed ids); the threshold is
chosen from the scores of all labelled rows, as the one that best tells good from bad without rejecting more than the
share ``MAX_LOSS`` of the good ones.

A null or empty text has no words and fails. Repeated rows are scored alike; an id that is labelled more than once
counts as good only if all its labels do. Without labels of both kinds the forest rejects nothing.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from siftwatch.llm.texts import by_bytes, release_worker, utf8
from siftwatch.staging import stage

TREES, TREE_ROWS, SEED = 128, 256, 1
MAX_LOSS = 0.01
BINS = 2000
MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of words

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
CONTINUATION = bytes(range(0x80, 0xC0))
CAPITALS = bytes(range(65, 91))
#: ASCII marks that prose does not use much.
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b not in b".,;:'\"-()")

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_capitals", "n_marks"]
#: Shares the forest sees. Repeated lines and passages, and digits, are heavy-tailed in good text too: as features they
#: made the rarest good texts look as odd as the bad ones. The base rules limit repetition instead.
FEATURES = ["symbols", "capitals", "marks", "word_length"]


def n_deleted(text: bytes, marks: bytes) -> int:
    return len(text) - len(text.translate(None, marks))


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    often = Counter(windows)
    hit = bytearray(len(words))
    for i, w in enumerate(windows):
        if often[w] > 1:
            hit[i : i + 3] = b"\1\1\1"
    return sum(hit)


def counts_of(text: bytes) -> tuple[int, ...]:
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text.translate(None, SPACES + CONTINUATION)),
        n_deleted(text, SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
        n_deleted(text, CAPITALS),
        n_deleted(text, MARKS),
    )


def counted(texts: list[bytes]) -> np.ndarray:
    return np.array([counts_of(t) for t in texts], np.int64).reshape(-1, len(COUNTS + MORE))


def shares(counts: np.ndarray) -> np.ndarray:
    """The features: shares that do not depend on a text's length."""
    by_name = dict(zip(COUNTS + MORE, counts.T.astype(float)))
    words, chars = (np.maximum(by_name[c], 1) for c in ("n_words", "word_chars"))
    return np.stack([by_name["n_symbols"] / chars, by_name["n_capitals"] / chars, by_name["n_marks"] / chars, by_name["word_chars"] / words], axis=1)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, all counts and all features of every text; no shuffle."""
    kinds = {c: T.LongType() for c in COUNTS + MORE} | {c: T.DoubleType() for c in FEATURES}
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(c, t) for c, t in kinds.items())])

    def run(batches):
        release_worker()
        for batch in batches:
            for b in by_bytes(batch, 1):
                counts = counted(utf8(b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, counts.T.copy()), *map(pa.array, shares(counts).T.copy())], names=schema.names)

    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, schema)


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED)


def usual_depth(n) -> np.ndarray:
    """Mean depth of an unsuccessful search in a random tree of n rows."""
    n = np.maximum(np.asarray(n, float), 1)
    harmonic = np.log(np.maximum(n - 1, 1)) + 0.5772156649
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


class Forest:
    """Trees as arrays: ``feature`` (-1 at a leaf), ``cut``, ``below`` (the child under the cut, the other follows it)
    and ``depth`` (of a leaf, with the usual depth of the rows it still holds)."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = SEED):
        random = np.random.default_rng(seed)
        self.size = min(tree_rows, len(rows))
        deepest = int(np.ceil(np.log2(max(self.size, 2))))
        self.trees = [self._grow(rows[random.choice(len(rows), self.size, replace=False)], random, deepest) for _ in range(trees if len(rows) else 0)]

    @staticmethod
    def _grow(rows, random, deepest):
        nodes, waiting = [[-1, 0.0, 0, 0.0]], [(0, rows, 0)]
        while waiting:
            at, own, depth = waiting.pop()
            low, high = own.min(axis=0), own.max(axis=0)
            spread = np.flatnonzero(high > low)
            if depth == deepest or not len(spread):
                nodes[at] = [-1, 0.0, 0, depth + float(usual_depth(len(own)))]
                continue
            f = int(random.choice(spread))
            cut = random.uniform(low[f], high[f])
            nodes[at] = [f, cut, len(nodes), 0.0]
            nodes += [[-1, 0.0, 0, 0.0], [-1, 0.0, 0, 0.0]]
            under = own[:, f] <= cut
            waiting += [(len(nodes) - 2, own[under], depth + 1), (len(nodes) - 1, own[~under], depth + 1)]
        feature, cut, below, depth = zip(*nodes)
        return np.array(feature), np.array(cut), np.array(below), np.array(depth)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """From 0 to 1, high for anomalies; 0 without trees."""
        if not self.trees:
            return np.zeros(len(rows))
        total = np.zeros(len(rows))
        for feature, cut, below, depth in self.trees:
            at = np.zeros(len(rows), np.int64)
            inner = np.flatnonzero(feature[at] >= 0)
            while len(inner):
                here = at[inner]
                at[inner] = below[here] + (rows[inner, feature[here]] > cut[here])
                inner = inner[feature[at[inner]] >= 0]
            total += depth[at]
        return 2 ** (-total / len(self.trees) / max(float(usual_depth(self.size)), 1e-9))


def grow(stats: DataFrame, id_col: str = "doc_id", trees: int = TREES, tree_rows: int = TREE_ROWS) -> Forest:
    """A forest on the rows of ``stats`` with the lowest hashed ids, ``trees * tree_rows`` at most."""
    most, place = trees * tree_rows, F.xxhash64(id_col, F.lit("forest"))
    # Only hashes that can be among the lowest are sorted and sent on: about twice as many rows as wanted.
    share = min(1.0, (2 * most + 1000) / max(stats.count(), 1))
    low = stats.where(place <= min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63)))
    order = [place, F.col(id_col), *(F.col(c) for c in FEATURES)]
    sample = low.orderBy(*order).select(*FEATURES).limit(most).toPandas()
    return Forest(sample.to_numpy(float), trees, tree_rows)


def score(stats: DataFrame, forest: Forest) -> DataFrame:
    schema = T.StructType([*(f for f in stats.schema if f.name != "anomaly"), T.StructField("anomaly", T.DoubleType())])
    sent = stats.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        release_worker()
        for b in batches:
            rows = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in FEATURES], axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sent.value.scores(rows))], names=schema.names)

    return stats.drop("anomaly").mapInArrow(run, schema)


def threshold(scored: DataFrame, labels: DataFrame, max_loss: float = MAX_LOSS, id_col: str = "doc_id") -> float:
    """The score above which rows are rejected: where the shares of bad and good rows above it differ most, with at
    most ``max_loss`` of the good ones. Both shares come from counts in ``BINS`` bins."""
    known = labels.where("quality IS NOT NULL").groupBy(id_col).agg(F.min("quality").alias("good"))
    bins = scored.join(known, id_col).groupBy(F.least(F.floor(F.col("anomaly") * BINS), F.lit(BINS - 1)).alias("bin"), (F.col("good") == 1).alias("good")).count()
    counts = np.zeros((2, BINS))
    for r in bins.collect():
        counts[int(r.good), r.bin] += r["count"]
    if not counts.sum(axis=1).all():
        return 1.0
    above = 1 - np.cumsum(counts, axis=1) / counts.sum(axis=1, keepdims=True)
    gain = np.where(above[1] <= max_loss, above[0] - above[1], -1)
    return float((np.argmax(gain) + 1) / BINS)


def fit(stats: DataFrame, labels: DataFrame) -> tuple[Forest, float]:
    """The forest and its threshold, from statistics with ``base_failed``."""
    passed = stats.where("NOT base_failed")
    forest = grow(passed)
    return forest, threshold(score(passed, forest), labels)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts, base rules, anomaly and verdict of every document."""
    stats = stage(statistics(docs).withColumn("base_failed", base_failed()))
    forest, limit = fit(stats, labels)
    kept = ~F.col("base_failed") & (F.col("anomaly") <= limit)
    return score(stats, forest).select("doc_id", *COUNTS, "base_failed", kept.alias("kept"), "anomaly", F.lit(limit).alias("threshold"))


def accepted(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that base rules or forest reject. Each row is judged by its own text, in place."""
    forest, limit = fit(stage(statistics(docs).withColumn("base_failed", base_failed())), labels)
    sent, at, schema = docs.sparkSession.sparkContext.broadcast(forest), docs.columns.index(text_col), docs.schema
    n_words, n_repeated = COUNTS.index("n_words"), COUNTS.index("n_repeat_words")

    def run(batches):
        release_worker()
        for batch in batches:
            for b in by_bytes(batch, at):
                counts = counted(utf8(b.column(at)))
                failed = (counts[:, n_words] < MIN_WORDS) | (counts[:, n_repeated] * 100 > counts[:, n_words] * MAX_REPEATED)
                yield b.filter(pa.array(~failed & (sent.value.scores(shares(counts)) <= limit)))

    return docs.mapInArrow(run, schema)
