"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns many arcs of a ring of hashes. A row goes to the shard of its arc; where that shard is full, it
continues clockwise to the next shard that is not. Capacities bound the balance: without slack they are the row counts
shared out as evenly as whole rows allow, so counts differ by one at most; with slack fewer rows leave their own arc.

Rows of one arc share their way round the ring, so where they go depends only on how many rows each arc has. Those
counts (arcs are a fixed number, whatever the table) are the only thing the driver sees; rows then find their shard by
their rank within their arc. Ranks come from counts of finer cells of the ring and a rank inside each cell, so that no
task sorts more than a cell. Equal rows (id and text) are folded to a count first, and so may be any share of the table.

A null id hashes like a value of its own; a null text has size 1 and the checksum of the empty text. Hashes depend on
id and text alone: copies of a text under different ids spread like any rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from siftwatch.staging import stage

VIRTUAL_NODES = 128
#: Rows per cell of the ring, about; the number of cells follows the table.
ROWS_PER_CELL = 20_000
RING_BITS = 48


def position(*values) -> int:
    """Where a virtual node sits: fixed by its name, so that a ring of more shards keeps the old nodes."""
    import hashlib

    return int.from_bytes(hashlib.blake2b("/".join(map(str, values)).encode(), digest_size=8).digest(), "big") >> (64 - RING_BITS)


def arcs(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> tuple[list[int], list[int]]:
    """Ends of the arcs in ring order, and the shard of each. A hash belongs to the first end at or after it, those
    behind the last end to the first arc."""
    nodes = sorted((position("shard", s, v), s) for s in range(shards) for v in range(virtual_nodes))
    return [p for p, _ in nodes], [s for _, s in nodes]


def allot(counts: list[int], owners: list[int], capacities: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot) for all rows of all arcs.

    Every shard takes the rows of its own arcs first, in ring order, as far as it has room. What is left of an arc
    moves clockwise, node by node, to the first shard with room; all leftovers move one node at a time, in ring order.
    """
    room, slot, out, left = list(capacities), [0] * len(capacities), [], []

    def take(arc: int, first: int, end: int, shard: int) -> int:
        n = min(end - first, room[shard])
        if n:
            out.append((arc, first, first + n, shard, slot[shard]))
            room[shard] -= n
            slot[shard] += n
        return first + n

    for arc, (n, shard) in enumerate(zip(counts, owners)):
        first = take(arc, 0, n, shard)
        if first < n:
            left.append((arc, first, n))
    step = 0
    while left:
        step += 1
        still = []
        for arc, first, end in left:
            first = take(arc, first, end, owners[(arc + step) % len(owners)])
            if first < end:
                still.append((arc, first, end))
        left = still
    return out


def capacities(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    even = [rows // shards + (s < rows % shards) for s in range(shards)]
    return [n + int(n * slack) for n in even]


def below(sorted_values: list[int], value: Column, step: int = 32) -> Column:
    """How many of the values are below ``value``: found among every ``step``-th first, then among the few between."""
    coarse = F.size(F.filter(F.array(*map(F.lit, sorted_values[step - 1 :: step])), lambda e: e < value)) * step
    fine = F.slice(F.array(*map(F.lit, sorted_values)), coarse + 1, F.lit(step))
    return coarse + F.size(F.filter(fine, lambda e: e < value))


def place(docs: DataFrame, shards: int, slack: float = 0.0, virtual_nodes: int = VIRTUAL_NODES, rows_per_cell: int = ROWS_PER_CELL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, shard and slot of every row."""
    text = F.coalesce(F.encode(text_col, "UTF-8"), F.lit(b""))
    slim = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("crc"),
        F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit("row"), F.col(text_col)), 64 - RING_BITS).alias("h"),
    )
    folded = stage(slim.groupBy("h", "id", "size", "crc").agg(F.count("*").alias("copies")))
    cells = max(1, folded.count() // rows_per_cell + 1)
    ends, owners = arcs(shards, virtual_nodes)
    # The arc of a hash: the number of ends before it, the ring closed.
    n = len(ends)
    found = below(ends, F.col("h")) % n
    cell = F.floor(F.col("h") / F.lit((1 << RING_BITS) / cells)).cast("int")
    rows = folded.withColumns({"arc": found, "cell": cell})

    per_cell = stage(rows.groupBy("arc", "cell").agg(F.sum("copies").alias("n")))
    per_arc = {r.arc: r.n for r in per_cell.groupBy("arc").agg(F.sum("n").alias("n")).collect()}
    counts = [per_arc.get(a, 0) for a in range(n)]
    segments = allot(counts, owners, capacities(sum(counts), shards, slack))

    ahead = W.partitionBy("arc").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    first = per_cell.select("arc", "cell", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_before"))
    inside = W.partitionBy("arc", "cell").orderBy("h", "id", "size", "crc").rowsBetween(W.unboundedPreceding, -1)
    ranked = rows.withColumn("_inside", F.coalesce(F.sum("copies").over(inside), F.lit(0))).join(first, ["arc", "cell"])
    start = F.col("_before") + F.col("_inside")
    each = ranked.select("arc", "id", "size", "crc", F.explode(F.sequence(start, start + F.col("copies") - 1)).alias("rank"))
    table = docs.sparkSession.createDataFrame(segments, "arc int, first long, end long, shard int, slot0 long")
    inner = (each["arc"] == table["arc"]) & (each["rank"] >= table["first"]) & (each["rank"] < table["end"])
    return each.join(F.broadcast(table), inner).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("slot0") + F.col("rank") - F.col("first")).alias("slot")
    )


def placed(docs: DataFrame, shards: int) -> DataFrame:
    """``place`` without slack, under the law of equal row counts."""
    return place(docs, shards).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
