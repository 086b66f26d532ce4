"""Groups of documents whose sets of word shingles are similar (Jaccard), exactly, by T-occurrence search.

1. Every text becomes a set of hashed shingles. Texts with equal sets are one *class* from here on.
2. Candidates. Sets at or above the threshold differ in at most d shingles, d known from their size. Shingles are dealt
   by hash into more than d segments, so two such sets agree in some whole segment. A class is listed under the hashes of
   its segments, the d + 1 of most shingles, since two sets in which at most d segments differ agree in one that is among
   these in both; classes that meet under one form a *block*, a superset of what can link. A shared passage does not
   make a meeting: a whole segment must agree.
3. Search. A block's sets go to one task, or are written as slices, once, that a grid of tasks reads if they are many. There, each set looks for
   others that share at least T shingles (DivideSkip): its longest inverted lists are put aside, the short ones are
   merged, and the few ids that occur often enough are probed in the long lists by binary search. Every pair of classes
   that could link and is not yet in one group is decided exactly; pairs are never written out, only groups.
4. Groups of slices are joined by connected components.

Lists, meetings and components are slim rows of hashes; texts move once, and only those of candidate classes. Tasks
pre-aggregate meetings, so that a segment many classes share arrives as a row per task.

Null texts and texts without words have empty sets and link with nothing; a text of fewer words than a shingle has one
shingle. A row without an id takes the group of its class, and links that class with nothing. An id that repeats with
different texts is in as many groups. Hashes have 64 bits: a meeting of two different sets or shingles of one block by
chance is left out of account.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs, parquet
from pyspark.sql import DataFrame, functions as F, types as T

from siftwatch.llm.texts import by_bytes, fresh, lower_words, one_per_worker, release_worker, utf8
from siftwatch.staging import stage, stage_path

SIZE = 3
#: Two sets link when 100 * |intersection| >= PER_CENT * |union|.
PER_CENT = 90
#: Segments beyond those that must be there, and more per segment expected to be empty, so that an empty segment seldom
#: has to count as agreement.
SPARE, SPARE_PER_EMPTY = 2, 4
#: Shingles in one slice of a block.
SLICE = 500_000
#: Tasks that the pairs of slices are dealt to at most.
GRID_TASKS = 2000
#: Times that sets may be as large as the smallest of their band, as a power of the largest ratio of two that link. In
#: wide bands few sets have partners in the next one, where they are listed as well.
BAND_POWER = 3
#: Size of the filter that holds back texts of no candidate class; eight megabytes.
BLOOM_BITS = 1 << 26
#: Meetings a task holds to aggregate.
HELD = 250_000
MEMO_WORDS = 300_000
#: Weight of a probe against a step of the merge, in choosing how many lists count as long.
MU = 0.0085

ODD = np.uint64(0x9E3779B97F4A7C15)


def step(k: int) -> np.uint64:
    """The k-th of widely spaced numbers."""
    return np.uint64(k * int(ODD) & (1 << 64) - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    def __init__(self, size: int):
        self.size, self.hashes = size, {}

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        """Sorted hashes of each text's shingles."""
        rows = [lower_words(t) for t in texts]
        new = set().union(*rows) - self.hashes.keys()
        if len(new) + len(self.hashes) > MEMO_WORDS:
            self.hashes.clear()
            new = set().union(*rows)
        self.hashes.update((w, xxhash.xxh64_intdigest(w)) for w in new)
        get = self.hashes.__getitem__
        return [self._set(np.fromiter(map(get, r), np.uint64, len(r))) for r in rows]

    def _set(self, words: np.ndarray) -> np.ndarray:
        if not len(words):
            return words
        size = min(self.size, len(words))
        out = np.full(len(words) - size + 1, size, np.uint64)
        for k in range(size):
            out = mixed(out * ODD + words[k : len(words) - size + 1 + k])
        return np.unique(out)


def shingler(size: int) -> Shingler:
    return one_per_worker(("jaccard", size), lambda: Shingler(size))


def class_of(shingles: np.ndarray) -> int:
    """Hash of a set."""
    total = mixed(shingles + ODD).sum(dtype=np.uint64)
    return int(mixed(np.array([total ^ step(len(shingles))], np.uint64)).view(np.int64)[0])


def sets_of(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """id, n (size of the set) and class of every row."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("class", T.LongType())])

    def run(batches):
        own = shingler(size)
        for batch in batches:
            for b in by_bytes(batch, 1):
                sets = own.sets(utf8(b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) for s in sets], pa.int64())], names=schema.names)

    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, schema)


@cache
def bands(per_cent: int, most: int = 1 << 40) -> np.ndarray:
    """First sizes of bands such that sets that link lie in one band or in two next to each other."""
    starts = [1]
    while starts[-1] < most:
        start = starts[-1]
        for _ in range(BAND_POWER):
            start = start * 100 // per_cent + 1
        starts.append(start)
    return np.array(starts)


def differing(size: int, per_cent: int) -> int:
    """The most shingles in which two linking sets of at most ``size`` shingles differ."""
    return 2 * size * (100 - per_cent) // (100 + per_cent)


def spare(size: int, d: int) -> int:
    """Segments beyond d + 1 for sets of ``size`` shingles: some of d + 1 are empty, few at 0.9, one in ninety at 0.8."""
    return SPARE + int(SPARE_PER_EMPTY * (d + 1) * np.exp(-size / (d + 1)))


def meetings(shingles: np.ndarray, per_cent: int) -> np.ndarray:
    """Hashes under which a set is listed: the largest of its segments in its own band, and in the next one if it has
    partners there. All sets order segments alike (by size, then by hash), so that two sets that agree in all but d
    segments agree in one of the first d + 1 of both."""
    starts = bands(per_cent)
    n = len(shingles)
    own = int(np.searchsorted(starts, n, "right")) - 1
    largest = n * 100 // per_cent  # of its partners
    out = []
    for band in (own, own + 1):
        most = int(starts[band + 1]) - 1
        differ = differing(most, per_cent)
        d = (n + min(most, largest)) * (100 - per_cent) // (100 + per_cent)
        if not d or largest < starts[band]:
            continue  # only equal sets link, or none
        k = differ + 1 + spare(most, differ)
        place = mixed(shingles + step(band))
        segment = ((place >> np.uint64(33)) % np.uint64(k)).astype(np.intp)
        sums = np.zeros(k, np.uint64)
        np.add.at(sums, segment, mixed(place + ODD))
        names = mixed(sums + mixed(np.arange(k, dtype=np.uint64) + step(band)))
        size = np.minimum(np.bincount(segment, minlength=k), 255)
        ranked = (255 - size).astype(np.uint64) << np.uint64(56) | names >> np.uint64(8)
        out.append(np.partition(ranked, d)[: d + 1])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def combined(keys: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Meetings summed up, by class: (key, first) per key, and for each further class two rows of one more key, which
    it shares with the first. A class's rows follow each other, so that they compress."""
    order = np.lexsort((classes, keys))
    keys, classes = keys[order], classes[order]
    new = np.append(True, keys[1:] != keys[:-1])
    first = classes[np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))]
    further = ~new & (classes != first)
    edges = np.unique(np.stack([classes[further], first[further]]), axis=1)
    shared = mixed(edges[0].view(np.uint64) * ODD + edges[1].view(np.uint64)).view(np.int64)
    keys, classes = np.concatenate([keys[new], shared, shared]), np.concatenate([classes[new], edges[0], edges[1]])
    order = np.argsort(classes, kind="stable")
    return keys[order], classes[order]


def candidate_edges(docs: DataFrame, size: int, per_cent: int, id_col: str, text_col: str) -> DataFrame:
    """Edges (a, b) between classes that agree in a segment, enough to connect all that do."""
    names = ["key", "class"]

    def rows(keys, classes):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in combined(np.concatenate(keys).view(np.int64), np.concatenate(classes))], names=names)

    def listed(batches):
        own, keys, classes, held = shingler(size), [], [], 0
        for batch in batches:
            for b in by_bytes(batch, 0):
                for s in own.sets(utf8(b.column(0))):
                    m = meetings(s, per_cent) if len(s) else s
                    if len(m):
                        keys.append(m)
                        classes.append(np.full(len(m), class_of(s), np.int64))
                        held += len(m)
                if held > HELD:
                    yield rows(keys, classes)
                    keys, classes, held = [], [], 0
        if held:
            yield rows(keys, classes)

    def met(batches):
        release_worker()
        last_key, last_first = None, None
        for b in batches:
            if not b.num_rows:
                continue
            k, v = (b.column(c).to_numpy() for c in names)
            new = np.append(k[0] != last_key, k[1:] != k[:-1])
            at = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
            starts = np.where(at >= 0, v[np.maximum(at, 0)], last_first if last_first is not None else 0)
            last_key, last_first = k[-1], starts[-1]
            out = np.unique(np.stack([v[v != starts], starts[v != starts]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1])], names=["a", "b"])

    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(text_col).alias("t"))
    lists = texts.mapInArrow(listed, "key long, class long")
    return lists.repartition("key").sortWithinPartitions("key", "class").mapInArrow(met, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for all ends of ``edges`` (a, b): the smallest v of each connected component.

    In each round every vertex takes its smallest neighbour, then that one's; edges are drawn again between what their
    ends took, and those within one vertex are gone. Few are left after the first round, whatever the groups' sizes,
    and the edges of a hub are split by adaptive execution, as the hub's label joins them.
    """
    links, labels = stage(edges.select("a", "b").distinct()), None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = stage(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("v"), F.least("a", "b").alias("up")))
        above = near.select(F.col("v").alias("u"), F.col("up").alias("root"))
        taken = stage(near.join(above, F.col("up") == F.col("u")).select("v", "root"))
        if labels is None:
            labels = taken
        else:
            new = taken.select(F.col("v").alias("old"), F.col("root").alias("new"))
            labels = stage(labels.join(new, F.col("root") == F.col("old"), "left").select("v", F.coalesce("new", "root").alias("root")))
        first, second = (taken.select(F.col("v").alias(x), F.col("root").alias(f"root_{x}")) for x in ("a", "b"))
        drawn = links.join(first, "a").join(second, "b").where("root_a <> root_b")
        links = stage(drawn.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct())
        if links.isEmpty():
            return labels


def search(sets: list[np.ndarray], side: np.ndarray, per_cent: int) -> np.ndarray:
    """Group (number of its first member) of each set of a block, by links between sets of side 0 and 1, or among all
    if there is one side."""
    m = len(sets)
    group = np.arange(m)
    sizes = np.array([len(s) for s in sets])
    two_sides = len(np.unique(side)) > 1
    tokens, dense = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(m), sizes)
    order = np.argsort(dense, kind="stable")  # inverted lists one after the other, ids ascending
    ids = owner[order]
    bounds = np.searchsorted(dense[order], np.arange(len(tokens) + 1))
    lengths = np.diff(bounds)
    probes = dense[order].astype(np.int64) * m + ids
    for x in range(m):
        if two_sides and side[x] == 0:
            continue
        n, own = int(sizes[x]), dense[ends[x] - sizes[x] : ends[x]]
        least = -(-per_cent * n // 100)
        by_length = own[np.argsort(lengths[own], kind="stable")]
        longest = int(lengths[by_length[-1]])
        if longest == 1:
            continue
        n_long = min(least - 1, int(least / (MU * np.log2(longest) + 1)))
        short, long = by_length[: n - n_long], by_length[n - n_long :]
        short = short[lengths[short] > 1]  # a list of x alone
        if not len(short):
            continue
        # Sorted runs, merged by a stable merge sort; ids that occur often enough stay.
        merged = np.sort(np.concatenate([ids[bounds[t] : bounds[t + 1]] for t in short]), kind="stable")
        found, count = np.unique(merged, return_counts=True)
        may = (count >= least - n_long) & (sizes[found] * 100 >= per_cent * n) & (n * 100 >= per_cent * sizes[found]) & (group[found] != group[x])
        may &= (side[found] == 0) if two_sides else (found < x)
        found, count = found[may], count[may]
        if not len(found):
            continue
        wanted = (long.astype(np.int64) * m)[:, None] + found
        at = np.minimum(np.searchsorted(probes, wanted), len(probes) - 1)
        overlap = count + (probes[at] == wanted).sum(axis=0)
        linked = found[(100 + per_cent) * overlap >= per_cent * (n + sizes[found])]
        for old in np.unique(group[linked]):
            low, high = sorted((old, group[x]))
            group[group == high] = low
    return group


def may_hold(ids: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter of one hash, ``BLOOM_BITS`` in size whatever the number of ids."""
    bit = F.pmod(F.xxhash64(column), F.lit(BLOOM_BITS))
    places = ids.select(bit.alias("bit")).selectExpr("cast(bit >> 5 as int) AS w", "shiftleft(1L, cast(bit & 31 as int)) AS own")
    words = places.groupBy("w").agg(F.bit_or("own").alias("bits")).toPandas()  # bounded by BLOOM_BITS
    out = np.zeros(BLOOM_BITS // 32, np.uint32)
    out[words["w"]] = words["bits"]
    return out


def sifted(texts: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows of ``texts`` whose ``column`` is in ``ids``, and a few more: so that a join with ``ids`` need not
    shuffle all texts."""
    filled = texts.sparkSession.sparkContext.broadcast(may_hold(ids, column))

    def run(batches):
        release_worker()
        for b in batches:
            bit = b.column(b.num_columns - 1).to_numpy()
            hit = filled.value[bit >> 5] >> (bit & 31).astype(np.uint32) & 1
            yield pa.RecordBatch.from_arrays(b.columns[:-1], names=b.schema.names[:-1]).filter(pa.array(hit.astype(bool)))

    return texts.withColumn("_bit", F.pmod(F.xxhash64(column), F.lit(BLOOM_BITS))).mapInArrow(run, texts.schema)


def linked(classes: np.ndarray, sets: list[bytes], side: np.ndarray, per_cent: int) -> pa.RecordBatch:
    """Each class with the first of its group."""
    own, once = np.unique(classes, return_index=True)
    group = search([np.frombuffer(sets[k], np.uint64) for k in once], side[once], per_cent)
    return pa.RecordBatch.from_arrays([pa.array(own), pa.array(own[group])], names=["class", "root"])


def block_links(members: DataFrame, per_cent: int) -> DataFrame:
    """(class, root) for all rows (block, class, set) of blocks that one task searches; a block's rows come together."""

    def solve(rows):
        return linked(np.array([r[1] for r in rows]), [r[2] for r in rows], np.zeros(len(rows), np.int64), per_cent)

    def run(batches):
        release_worker()
        held, last = [], None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != last:
                    if held:
                        yield solve(held)
                    held, last = [], row[0]
                held.append(row)
        if held:
            yield solve(held)

    dealt = members.select("block", "class", "set").repartition("block").sortWithinPartitions("block", "class")
    return dealt.mapInArrow(run, "class long, root long")


def slice_of(folder: str, block: int, number: int) -> pa.Table | None:
    """The classes and sets of one written slice."""
    store, place = fs.FileSystem.from_uri(folder)
    path = f"{place}/block={block}/slice={number}"
    if store.get_file_info(path).type == fs.FileType.NotFound:
        return None
    return parquet.read_table(path, filesystem=store, partitioning=None, columns=["class", "set"])


def grid_links(members: DataFrame, slices: DataFrame, per_cent: int) -> DataFrame:
    """(class, root) for all rows (block, slices, class, set) of blocks that are cut into ``slices (block, slices)``.
    A slice is written once, and the task of each pair of slices reads two of them: sets are moved once, however many
    slices theirs meets."""
    folder = stage_path(members.sparkSession)
    own = F.pmod(F.xxhash64("class"), F.col("slices")).cast("int")
    dealt = members.select("block", own.alias("slice"), "class", "set").repartition("block", "slice")
    dealt.write.partitionBy("block", "slice").parquet(folder)

    def run(batches):
        release_worker()
        for batch in batches:
            for block, i, j in zip(*(c.to_pylist() for c in batch.columns)):
                tables = [slice_of(folder, block, k) for k in dict.fromkeys((i, j))]
                if any(t is None for t in tables):
                    continue
                sets = [x for t in tables for x in t.column("set").to_pylist()]
                side = np.repeat(np.arange(len(tables)), [t.num_rows for t in tables])
                yield linked(np.concatenate([t.column("class").to_numpy() for t in tables]), sets, side, per_cent)

    grid = slices.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    grid = stage(grid.select("block", "i", F.explode(F.sequence("i", F.col("slices") - 1)).alias("j")))
    return grid.repartition(min(GRID_TASKS, max(1, grid.count()))).mapInArrow(run, "class long, root long")


def grouped(docs: DataFrame, size: int = SIZE, per_cent: int = PER_CENT, id_col: str = "doc_id", text_col: str = "text", slice_size: int = SLICE) -> DataFrame:
    """id, ``n_shingles`` and ``component_id`` (the smallest id that links reach) of every row."""
    rows = stage(sets_of(docs, size, id_col, text_col))
    classes = stage(rows.where("n > 0").groupBy("class").agg(F.min("id").alias("first"), F.max("n").alias("n")))
    blocks = components(stage(candidate_edges(docs, size, per_cent, id_col, text_col)))
    members = stage(blocks.withColumnRenamed("root", "block").join(classes, F.col("v") == F.col("class")).drop("v"))
    slices = stage(members.groupBy("block").agg(F.ceil(F.sum("n") / slice_size).cast("int").alias("slices")))
    members = stage(members.join(slices, "block"))

    schema = T.StructType([*(members.schema[c] for c in ("block", "slices", "class")), T.StructField("set", T.BinaryType())])

    def sets(batches):
        own = shingler(size)
        for batch in batches:
            for b in by_bytes(batch, 0):
                found = own.sets(utf8(b.column(0)))
                same = pa.array([len(s) > 0 and class_of(s) == c for s, c in zip(found, b.column(3).to_pylist())], pa.bool_())  # an id may have other texts
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([s.tobytes() for s in found], pa.binary())], names=schema.names).filter(same)

    texts = docs.select(F.col(id_col).alias("first"), F.col(text_col).alias("_text"))

    def with_sets(some):
        found = sifted(texts, some, "first").join(some.select("first", "block", "slices", "class"), "first")
        return found.select("_text", "block", "slices", "class").mapInArrow(sets, schema)

    several = slices.where("slices > 1")
    met = block_links(with_sets(members.where("slices = 1")), per_cent)
    if not several.isEmpty():
        met = met.unionByName(grid_links(with_sets(members.where("slices > 1")), several, per_cent))
    links = stage(met.where("class <> root").distinct().select(F.col("class").alias("a"), F.col("root").alias("b")))
    roots = components(links)

    whole = classes.join(roots, F.col("class") == F.col("v"), "left").select("class", "first", F.coalesce("root", "class").alias("root"))
    firsts = whole.groupBy("root").agg(F.min("first").alias("component"))
    by_class = stage(whole.join(firsts, "root").select("class", "component"))
    return rows.join(by_class, "class", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"))


def first_of_each(docs: DataFrame, size: int = SIZE, per_cent: int = PER_CENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id. Rows without an id stay; rows that
    repeat an id and text stay once."""
    groups = stage(grouped(docs, size, per_cent, id_col, text_col))
    rows = fresh(docs.columns, "_rows")
    heads = groups.where(F.col(id_col) == F.col("component_id")).groupBy(id_col).agg(F.count("*").alias(rows))
    kept = docs.join(heads, id_col, "left").where(F.col(rows).isNotNull() | F.col(id_col).isNull())
    if heads.where(F.col(rows) > 1).isEmpty():
        return kept.select(*docs.columns)
    once = F.coalesce(F.col(rows), F.lit(1)) == 1
    return kept.where(once).unionByName(kept.where(~once).dropDuplicates([id_col, text_col])).select(*docs.columns)
