"""Joins whose keys are hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key counts as hot from this many rows, or from the rows that a shuffle task has on average if these are more, but
#: never from more than MOST_ROWS. So there are no more hot keys than tasks, or than rows / MOST_ROWS.
HOT_ROWS = 100_000
MOST_ROWS = 10_000_000
#: Cells of the first, coarse count of rows by hash of their key.
CELLS = 1 << 16
#: Rows of one side of a block of a hot join, at least: a block of both sides has about BLOCK ** 2 pairs.
BLOCK = 2_048


def hot_limit(spark: SparkSession, rows: int) -> int:
    return max(HOT_ROWS, min(MOST_ROWS, rows // max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))))


def hot_counts(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame | None:
    """``(*keys, __n)`` of the keys with more than ``limit`` rows, or None if there are none. Null keys are not counted.

    Rows are counted by hash first, which shuffles CELLS numbers a task; only keys of full cells are counted one by one.
    """
    known = df.select(*keys).dropna()
    cell = F.pmod(F.xxhash64(*keys), F.lit(CELLS)).alias("__cell")
    full = known.groupBy(cell).agg(F.count(F.lit(1)).alias("__m")).where(F.col("__m") > limit).select("__cell")
    cells = [r[0] for r in full.collect()]  # at most CELLS numbers
    if not cells:
        return None
    if len(cells) < CELLS // 8:
        known = known.where(cell.isin(cells))
    counts = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > limit)
    return None if counts.isEmpty() else counts


def hot_lookup(big: DataFrame, key: str, unique: DataFrame, rows: int, how: str = "left") -> DataFrame:
    """Joins ``big`` with ``unique`` (one row per ``key``) on ``key``; a hot key never meets in one task.

    ``rows`` is the number of rows of ``big``. Rows with hot keys are joined with a broadcast of their matches, of which
    there are few by the definition of hot; the rest by a shuffle in which no key exceeds the threshold.
    """
    limit = hot_limit(big.sparkSession, rows)
    hot = hot_counts(big, [key], limit) if rows > limit else None
    if hot is None:
        return big.join(unique, key, how)
    hot = hot.select(key)
    matches = unique.join(F.broadcast(hot), key, "left_semi")
    cold = big.join(F.broadcast(hot), key, "left_anti").join(unique, key, how)
    return big.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(matches), key, how).unionByName(cold)


def blocked_join(left: DataFrame, right: DataFrame, keys: Sequence[str], spread_left: str, spread_right: str, block: int | None = None) -> DataFrame:
    """Inner equi-join in which the pairs of one key value are spread over many tasks, whatever its number of rows.

    Keys with more than ``block`` rows on both sides are hot. Both sides of a hot key are cut into blocks, by hash of the columns
    ``spread_left`` and ``spread_right``, and each block of one side meets each of the other on its own. The two sides
    must share no column but ``keys``; key columns come first in the result.
    """
    block = block or BLOCK
    a, b = hot_counts(left, keys, block), None
    if a is not None:
        b = hot_counts(right, keys, block)
    if a is None or b is None:
        return left.join(right, list(keys))
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
    # fewer than rows / block keys, so Spark decides by size whether they are broadcast
    hot = a.withColumnRenamed("__n", "__na").join(b.withColumnRenamed("__n", "__nb"), list(keys)).select(*keys, blocks("__na").alias("__p"), blocks("__nb").alias("__q"))
    cut = lambda side, spread, own, other, x, y: side.join(hot, list(keys)).select(
        *side.columns, F.pmod(F.xxhash64(spread), F.col(own)).cast("int").alias(x), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(y)
    )
    at = [*keys, "__i", "__j"]
    met = cut(left, spread_left, "__p", "__q", "__i", "__j").join(cut(right, spread_right, "__q", "__p", "__j", "__i"), at).drop("__i", "__j")
    cold = left.join(hot, list(keys), "left_anti").join(right, list(keys))
    return cold.unionByName(met)
