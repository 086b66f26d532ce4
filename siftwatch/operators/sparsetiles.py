"""Pairs of sparse unit vectors at or above a cosine threshold, block by block from written files.

Rows are written where they are, without a shuffle; blocks are runs of the files' row groups, bounded in rows and in
entries. A tile is a pair of blocks; its task reads the two and hands on nothing but pairs that reach the threshold, so
neither chance meetings nor vectors are ever shuffled, and a task holds two blocks whatever the number of rows.

Within a tile two rows meet where they share a prefix term and the product of their norms from that term on reaches
the threshold: at their first common term it must, so the bound is exact. Pairs that met are multiplied out, the heaviest
entries first, until what is left of both rows can't reach the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs, parquet
from pyspark.sql import DataFrame, SparkSession, functions as F

from siftwatch.functions import arrays
from siftwatch.staging import stage_path

# Rows and vector entries of one block, and bytes of the row groups that it is made of.
BLOCK_ROWS = 8192
BLOCK_ENTRIES = 2_000_000
GROUP_BYTES = 4 << 20
# Room for rounding; only ever lets more pairs through.
SLACK = 1e-9
# Meetings worked on at once; those of a tile that are sorted to find the pairs, and beyond that places of a table.
MEETINGS = 1_000_000
SORTED = 8_000_000
PLACES = 16_000_000
# Entries of candidate pairs worked on at once.
VALUES = 1_000_000
# Shares of a row's squared norm after which a pair is given up if the rest can't reach the threshold.
SHARES = (0.6, 0.85)
TASKS = 2000
# Blocks on each side of a square of tiles that one task works on, where there are enough for all cores.
SIDE = 4
# Blocks that stand for all when pairs are estimated.
TRIAL_BLOCKS = 6

PAIR_SCHEMA = "i bigint, j bigint, sim double"
COLUMNS = ("row_id", "idx", "tf", "df", "n_rows", "prefix_at", "rest")


@dataclass(frozen=True)
class Blocks:
    """Unit vectors written by block. Rows without an id match nothing and are left out. ``parts``: the row groups
    ``(file, number)`` of each block."""

    spark: SparkSession
    folder: str
    parts: tuple[tuple[tuple[str, int], ...], ...]
    n_rows: int
    schema: object

    @property
    def n(self) -> int:
        return len(self.parts)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.folder)


def write(units: DataFrame, block_rows: int = BLOCK_ROWS, block_entries: int = BLOCK_ENTRIES) -> Blocks:
    """``units`` with the ``COLUMNS``, and any others, as blocks; ``idx`` numbers the terms, ``prefix_at`` has the places
    of the prefix's entries, ``n_rows`` the rows that frequencies are out of."""
    spark = units.sparkSession
    folder = stage_path(spark)
    rows = units.where("row_id IS NOT NULL")
    rows.write.option("parquet.block.size", GROUP_BYTES).option("maxRecordsPerFile", block_rows).parquet(folder)
    store, place = fs.FileSystem.from_uri(folder)
    blocks: list[list[tuple[str, int]]] = []
    total = n = entries = 0
    for path in sorted(f.path for f in store.get_file_info(fs.FileSelector(place)) if f.path.endswith(".parquet")):
        seen = parquet.read_metadata(path, filesystem=store)
        column = seen.schema.to_arrow_schema().names.index("idx")
        for k in range(seen.num_row_groups):
            group = seen.row_group(k)
            if not group.num_rows:
                continue
            own = group.column(column).num_values
            if not blocks or n + group.num_rows > block_rows or entries + own > block_entries:
                blocks.append([])
                n = entries = 0
            blocks[-1].append((path[path.rindex("/") + 1 :], k))
            n, entries, total = n + group.num_rows, entries + own, total + group.num_rows
    return Blocks(spark, folder, tuple(map(tuple, blocks)), total, rows.schema)


@dataclass(frozen=True)
class _Block:
    ids: np.ndarray
    start: np.ndarray  # where a row's entries begin, and after the last row where they end
    terms: np.ndarray  # distinct, ascending
    code: np.ndarray  # entries: place of the term among them, and value
    val: np.ndarray
    term: np.ndarray  # prefix entries by term, and by norm from there on downwards: term, row, norm, value
    row: np.ndarray
    tail: np.ndarray
    weight: np.ndarray
    rest: np.ndarray  # norm of a row outside its prefix
    merged: np.ndarray  # rows that hold a term more than once: only where rows of one id were merged
    cuts: np.ndarray  # by share: how many of a row's entries, heaviest first, hold it, and the squared norm of the others
    left: np.ndarray


def part(folder: str, column: str, number: int) -> pa.Table | None:
    """The rows of one value of the column that a Parquet table is written by."""
    store, place = fs.FileSystem.from_uri(folder)
    if store.get_file_info(f"{place}/{column}={number}").type == fs.FileType.NotFound:
        return None
    return parquet.read_table(f"{place}/{column}={number}", filesystem=store, partitioning=None)


def _read(folder: str, parts: tuple[tuple[str, int], ...], columns: tuple[str, ...]) -> pa.Table:
    store, place = fs.FileSystem.from_uri(folder)
    tables = []
    for name in dict.fromkeys(f for f, _ in parts):
        with store.open_input_file(f"{place}/{name}") as source:
            numbers = [k for f, k in parts if f == name]
            tables.append(parquet.ParquetFile(source).read_row_groups(numbers, list(columns), use_threads=False))
    return pa.concat_tables(tables).combine_chunks()


@lru_cache(SIDE + 1)
def _block(folder: str, parts: tuple[tuple[str, int], ...]) -> _Block:
    table = _read(folder, parts, COLUMNS)
    n = table.num_rows
    own, idx = arrays.ragged(table.column("idx"))
    _, tf = arrays.ragged(table.column("tf"))
    _, df = arrays.ragged(table.column("df"))
    val = weights(own, tf, df, table.column("n_rows").to_numpy())
    row, at = arrays.ragged(table.column("prefix_at"))
    ids, rest = table.column("row_id").to_numpy(), table.column("rest").to_numpy()
    del table, tf, df
    start = np.r_[0, np.cumsum(np.bincount(own, minlength=n))]
    at = start[row] + at
    term, weight = idx[at], val[at]
    square = weight * weight
    total = np.cumsum(square)
    end = np.r_[0.0, total][np.cumsum(np.bincount(row, minlength=n))]
    tail = np.sqrt(np.maximum(end[row] - total + square + rest[row] ** 2, 0.0))
    order = np.lexsort((-tail, term))
    twice = (idx[1:] == idx[:-1]) & (own[1:] == own[:-1])
    merged = np.zeros(n, bool)
    merged[own[1:][twice]] = True
    held = np.zeros(int(idx.max()) + 1 if len(idx) else 0, bool)
    held[idx] = True
    code = (np.cumsum(held, dtype=np.int32) - 1)[idx]
    square = val * val
    whole = np.bincount(own, weights=square, minlength=n)
    sums = np.cumsum(square)
    before = sums - square - np.r_[0.0, sums][start[:-1]][own]
    cuts, left = [], []
    for share in SHARES:
        inside = before < share * whole[own]
        cuts.append(np.bincount(own[inside], minlength=n))
        left.append(whole - np.bincount(own[inside], weights=square[inside], minlength=n))
    prefix = (term[order], row[order].astype(np.int32), tail[order], weight[order])
    return _Block(ids, start, np.flatnonzero(held), code, val, *prefix, rest, merged, np.stack(cuts), np.stack(left))


def weights(row: np.ndarray, tf: np.ndarray, df: np.ndarray, n_rows: np.ndarray) -> np.ndarray:
    """Values of the entries of unit vectors: ``tf * ln((n_rows + 1) / (df + 1))`` by (the row's norm + 1e-8)."""
    val = tf * np.log((n_rows[row] + 1) / (df + 1.0))
    norm = np.sqrt(np.bincount(row, weights=val * val, minlength=len(n_rows)))
    return val / (norm + 1e-8)[row]


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
    return starts, np.diff(np.r_[starts, len(x)])


def _met(a: _Block, b: _Block, first: np.ndarray, later: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of a row of ``a`` marked ``first`` and one of ``b`` marked ``later`` that meet, ascending by the latter."""
    least = threshold - SLACK
    x, y = np.flatnonzero(first[a.row] & (a.tail >= least)), np.flatnonzero(later[b.row] & (b.tail >= least))
    (of_a, _), (of_b, n_b) = _runs(a.term[x]), _runs(b.term[y])
    if not len(x) or not len(y):
        return
    lists, wanted = a.term[x][of_a], b.term[y][of_b]
    at = np.minimum(np.searchsorted(lists, wanted), len(lists) - 1)
    shared = np.repeat(np.where(lists[at] == wanted, at, -1), n_b)
    y, code_y = y[shared >= 0], shared[shared >= 0]
    # Lists of ``a`` from the largest norm down: what an entry of ``b`` can meet is the head of its list.
    code_x = np.repeat(np.arange(len(of_a)), np.diff(np.r_[of_a, len(x)]))
    lack = code_x + np.clip(1.0 - a.tail[x], 0.0, 0.999)
    begin = of_a[code_y]
    end = np.searchsorted(lack, code_y + np.clip(1.0 - least / b.tail[y] + SLACK, 0.0, 0.9995), "right")
    n = np.maximum(end - begin, 0)
    row_x, row_y, width = a.row[x], b.row[y], len(a.ids)

    def meetings(some: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for s in _pieces(some, n[some], MEETINGS):
            e = some[s]
            m = n[e]
            place = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(begin[e], m)
            yield row_x[place], np.repeat(row_y[e], m)

    if n.sum() <= SORTED:
        every = [np.unique(q.astype(np.int64) * width + p) for p, q in meetings(np.arange(len(n)))]
        if every:
            pairs = np.unique(np.concatenate(every))
            yield pairs % width, pairs // width
        return
    step = max(1, PLACES // width)
    for low in range(0, len(b.ids), step):
        table = np.zeros((min(step, len(b.ids) - low), width), bool)
        for p, q in meetings(np.flatnonzero((row_y >= low) & (row_y < low + step))):
            table[q - low, p] = True
        q, p = np.nonzero(table)
        yield p, q + low


def _met_merged(a: _Block, b: _Block, first: np.ndarray, later: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same where rows of one id were merged and hold terms several times, so that norms no longer bound products:
    by the sums over all meetings of their prefix entries, and the most that what lies beyond the prefixes adds."""
    step = max(1, PLACES // 8 // len(a.ids))
    x = np.flatnonzero(first[a.row])
    for low in range(0, len(b.ids), step):
        some = np.zeros(len(b.ids), bool)
        some[low : low + step] = later[low : low + step]
        y = np.flatnonzero(some[b.row])
        shape = (len(a.ids), min(step, len(b.ids) - low))
        acc, of_a, of_b = np.zeros(shape), np.zeros(shape), np.zeros(shape)
        begin, end = (np.searchsorted(a.term[x], b.term[y], side) for side in ("left", "right"))
        n = end - begin
        for s in _pieces(y, n, MEETINGS):
            m = n[s]
            at = x[np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(begin[s], m)]
            to = np.repeat(y[s], m)
            place = (a.row[at], b.row[to] - low)
            for held, product in ((acc, a.weight[at] * b.weight[to]), (of_a, a.weight[at] ** 2), (of_b, b.weight[to] ** 2)):
                np.add.at(held, place, product)
        beyond = np.maximum(
            a.rest[:, None] * np.sqrt(np.maximum(1.0 - of_b, 0.0)),
            b.rest[None, low : low + shape[1]] * np.sqrt(np.maximum(1.0 - of_a, 0.0)),
        )
        q, p = np.nonzero(((acc > 0) & (acc + beyond >= threshold - SLACK)).T)
        yield p, q + low


def _numbers(a: _Block, b: _Block) -> np.ndarray:
    """The number in ``b`` of the term of every entry of ``a``; the last one for terms that ``b`` lacks."""
    code = np.minimum(np.searchsorted(b.terms, a.terms), len(b.terms) - 1)
    return np.where(b.terms[code] == a.terms, code, len(b.terms)).astype(np.int32)[a.code]


def _dots(
    a: _Block, b: _Block, number: np.ndarray, x: np.ndarray, y: np.ndarray, low: np.ndarray, high: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Products of rows ``x`` and ``y`` (ascending), and the squared norm of what they share of ``y``, over the entries
    from ``low`` to ``high`` of each row of ``a``. ``number`` is ``_numbers(a, b)``. A row of ``b`` is laid out over its
    block's terms, and the entries of all rows it meets pick their factors there."""
    n = (high - low)[x]
    if not n.all():
        out = np.zeros((2, len(x)))
        some = n > 0
        if some.any():
            out[:, some] = _dots(a, b, number, x[some], y[some], low, high)
        return out[0], out[1]
    ends = np.cumsum(n)
    begins = ends - n
    at = np.arange(ends[-1]) + np.repeat((a.start[:-1] + low)[x] - begins, n)
    number, factor = number[at], np.zeros(len(at))
    wide = np.zeros(len(b.terms) + 1)  # the last place is for terms that ``b`` lacks
    starts = np.flatnonzero(np.diff(y, prepend=-1))
    for row, s, e in zip(y[starts].tolist(), begins[starts].tolist(), [*begins[starts[1:]].tolist(), len(at)]):
        own = slice(b.start[row], b.start[row + 1])
        code = b.code[own]
        wide[code[::-1]] = b.val[own][::-1]  # of entries of one term the first
        factor[s:e] = wide[number[s:e]]
        wide[code] = 0.0
    return np.add.reduceat(a.val[at] * factor, begins), np.add.reduceat(factor * factor, begins)


def _pieces(x: np.ndarray, size: np.ndarray, most: int) -> Iterator[slice]:
    part = np.cumsum(size) // most
    cuts = np.flatnonzero(np.diff(part, prepend=-1)) if len(x) else np.zeros(0, np.int64)
    for s, e in zip(cuts, np.r_[cuts[1:], len(x)]):
        yield slice(s, e)


def _reaching(
    a: _Block, b: _Block, number: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: float, whole: bool = False
) -> Iterator[pa.RecordBatch]:
    """Of the pairs of rows ``x`` and ``y`` (ascending) those that reach the threshold. ``whole`` products only, where
    terms repeat and norms don't bound what is left."""
    size = np.diff(a.start)
    for s in _pieces(x, size[x], VALUES):
        p, q = x[s], y[s]
        sim, shared, low = np.zeros(len(p)), np.zeros(len(p)), np.zeros(len(size), np.int64)
        for high, left in () if whole else zip(a.cuts, a.left):
            more, held = _dots(a, b, number, p, q, low, high)
            sim, shared, low = sim + more, shared + held, high
            most = sim + np.sqrt(np.maximum(left[p], 0.0) * np.maximum(1.0 - shared, 0.0))
            may = most >= threshold - SLACK
            p, q, sim, shared = p[may], q[may], sim[may], shared[may]
            if not len(p):
                break
        if not len(p):
            continue
        sim = sim + _dots(a, b, number, p, q, low, size)[0]
        hit = sim >= threshold
        if hit.any():
            i, j = a.ids[p[hit]], b.ids[q[hit]]
            columns = (np.minimum(i, j), np.maximum(i, j), sim[hit])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["i", "j", "sim"])


def _tile(a: _Block, b: _Block, met, threshold: float) -> Iterator[pa.RecordBatch]:
    """The pairs ``met`` that reach the threshold. The entries of the shorter row are looked up in the longer one."""
    of_a, of_b, size_a, size_b = _numbers(a, b), _numbers(b, a), np.diff(a.start), np.diff(b.start)
    for x, y in met:
        short = size_a[x] <= size_b[y]
        yield from _reaching(a, b, of_a, x[short], y[short], threshold)
        x, y = x[~short], y[~short]
        order = np.argsort(x, kind="stable")
        yield from _reaching(b, a, of_b, y[order], x[order], threshold)


def _ascending(a: _Block, b: _Block, met) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs ``met`` in which the row of ``a`` has the smaller id."""
    for x, y in met:
        keep = a.ids[x] < b.ids[y]
        yield x[keep], y[keep]


def _tile_pairs(a: _Block, b: _Block, of_a, of_b, threshold: float) -> Iterator[pa.RecordBatch]:
    """Pairs of two blocks, or of one block twice; ``of_a`` and ``of_b`` are the marks ``(first, later)`` of the rows."""
    (first_a, later_a), (first_b, later_b) = of_a, of_b
    ways = [(a, b, first_a, later_b)] if a is b else [(a, b, first_a, later_b), (b, a, first_b, later_a)]
    if a is not b and (first_a == later_a).all() and (first_b == later_b).all():  # what meets is the same both ways
        yield from _tile(a, b, _met(a, b, first_a & ~a.merged, first_b & ~b.merged, threshold), threshold)
    else:
        for p, q, first, later in ways:
            met = _met(p, q, first & ~p.merged, later & ~q.merged, threshold)
            yield from _tile(p, q, _ascending(p, q, met), threshold)
    for p, q, first, later in ways:
        for some, other in ((first & p.merged, later), (first & ~p.merged, later & q.merged)):
            if some.any() and other.any():
                # A term that a row holds several times counts each time for the smaller id, once for the larger.
                for x, y in _ascending(p, q, _met_merged(p, q, some, other, threshold)):
                    yield from _reaching(p, q, _numbers(p, q), x, y, threshold, whole=True)


def _marks(blocks: Blocks, roles: DataFrame) -> str:
    """``roles`` written by block."""
    folder, parts, marks = blocks.folder, blocks.parts, stage_path(blocks.spark)

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                own = _read(folder, parts[number], ("row_id",)).column("row_id").combine_chunks()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), number, np.int32)), own], names=["block", "row_id"])

    placed = blocks.spark.range(0, blocks.n, 1, max(1, min(TASKS, blocks.n))).mapInArrow(ids, "block int, row_id bigint")
    dealt = roles.select("row_id", "first", "later").join(placed, "row_id")
    dealt.repartition(max(1, blocks.n), "block").write.partitionBy("block").parquet(marks)
    return marks


def pairs(blocks: Blocks, threshold: float, roles: DataFrame | None = None) -> DataFrame:
    """All ``(i, j, sim)`` with ``i < j`` and similarity at or above ``threshold``. With ``roles (row_id, first,
    later)`` only pairs of a row marked ``first`` and a larger one marked ``later``; rows without roles have none."""
    spark, folder, parts, n = blocks.spark, blocks.folder, blocks.parts, blocks.n
    if not n:
        return spark.createDataFrame([], PAIR_SCHEMA)
    marks = None if roles is None else _marks(blocks, roles)
    cores = spark.sparkContext.defaultParallelism
    side = SIDE if n * n >= 8 * cores * SIDE * SIDE else 1
    squares = -(-n // side)
    starts = np.cumsum(np.r_[0, np.arange(squares, 1, -1)])  # number of the first square of each row of squares

    def flags(number: int, block: _Block) -> np.ndarray:
        if marks is None:
            return np.ones((2, len(block.ids)), bool)
        out = np.zeros((2, len(block.ids)), bool)
        table = part(marks, "block", number)
        if table is not None:
            order = np.argsort(block.ids)
            at = order[np.searchsorted(block.ids[order], table.column("row_id").to_numpy())]
            for k, c in enumerate(("first", "later")):
                out[k][at] = table.column(c).to_numpy()
        return out

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays.release()
        for batch in batches:
            for square in batch.column(0).to_pylist():
                row = int(np.searchsorted(starts, square, "right")) - 1
                column = row + square - int(starts[row])
                for q in range(column * side, min(n, (column + 1) * side)):
                    for p in range(row * side, min(q + 1, (row + 1) * side)):
                        a = _block(folder, parts[p])
                        b = a if p == q else _block(folder, parts[q])
                        arrays.release()
                        of_a = flags(p, a)
                        yield from _tile_pairs(a, b, of_a, of_a if p == q else flags(q, b), threshold)
        _block.cache_clear()
        arrays.release()

    total = squares * (squares + 1) // 2
    return spark.range(0, total, 1, min(TASKS, total)).mapInArrow(compare, PAIR_SCHEMA)


def estimated_pairs(blocks: Blocks, threshold: float, roles: DataFrame | None = None) -> float:
    """About how many pairs there are, from a few tiles spread over all. Only good for choosing how to go on."""
    n = blocks.n
    if not n:
        return 0.0
    few = max(1, min(n, TRIAL_BLOCKS))
    chosen = sorted(set(np.linspace(0, n - 1, few).astype(int).tolist()))
    part = Blocks(blocks.spark, blocks.folder, tuple(blocks.parts[k] for k in chosen), blocks.n_rows, blocks.schema)
    return pairs(part, threshold, roles).count() * (n * (n + 1)) / (few * (few + 1))


