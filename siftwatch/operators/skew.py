"""Join and numbering helpers whose tasks stay bounded when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from siftwatch.staging import stage

# A key above this many rows is cut into slices of about this size.
ROWS_PER_SALT = 1_000_000
# A side table up to this many rows is copied to every executor.
MAX_LOOKUP_ROWS = 20_000


def salted_join(
    big: DataFrame,
    small: DataFrame,
    key: str,
    how: str = "inner",
    rows_per_salt: int = ROWS_PER_SALT,
    spread: str | None = None,
    most_per_key: int | None = None,
) -> DataFrame:
    """``big`` join ``small`` on ``key`` where ``big`` may be skewed on it.

    Keys with more than ``rows_per_salt`` rows in ``big`` are hot; there are at most ``|big| / rows_per_salt`` of
    them, which bounds the broadcast table of hot keys. Their rows are spread over slices by ``spread`` (a column
    of ``big``) and the matching rows of ``small`` are repeated once per slice, so every row still meets all its
    partners exactly once. ``most_per_key``, a known bound on the rows of any key in ``big``, can rule out hot keys
    and then gives a plain join.
    """
    if most_per_key is not None and most_per_key <= rows_per_salt:
        return big.join(small, key, how)
    spread_col = F.col(spread) if spread else F.struct(*big.columns)
    hot = F.broadcast(
        big.groupBy(key)
        .count()
        .where(F.col("count") > rows_per_salt)
        .select(key, F.ceil(F.col("count") / rows_per_salt).cast("int").alias("_slices"))
    )
    left = (
        big.join(hot, key, "left")
        .withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(spread_col), F.col("_slices")).cast("int"), F.lit(0)))
        .drop("_slices")
    )
    right = (
        small.join(hot, key, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_slices"), F.lit(1)) - 1)))
        .drop("_slices")
    )
    return left.join(right, [key, "_salt"], how).drop("_salt")


def lookup_join(
    big: DataFrame, small: DataFrame, key: str, how: str = "inner", max_rows: int = MAX_LOOKUP_ROWS
) -> DataFrame:
    """Join with a small written or literal table: its rows are counted first, broadcast up to ``max_rows``, and
    joined by a salted shuffle beyond that."""
    if small.limit(max_rows + 1).count() <= max_rows:
        return big.join(F.broadcast(small), key, how)
    return salted_join(big, small, key, how)


def renumber(df: DataFrame, order: str, name: str = "new_row_id") -> DataFrame:
    """Dense 0-based numbers along the unique column ``order``, whatever its values.

    The rows are sorted by ranges and written with their partition and place in it. Only the partitions' row counts
    go through a single running sum, and only that table, one row per partition, is broadcast.
    """
    spot = F.monotonically_increasing_id()
    placed = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_spot", spot)
    rows = stage(placed).withColumns({"_part": F.shiftright("_spot", 33), "_place": F.col("_spot").bitwiseAND((1 << 33) - 1)})
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = rows.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_place"))
    return numbered.drop("_spot", "_part", "_place", "_start")
