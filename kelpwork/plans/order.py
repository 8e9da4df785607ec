"""Positions in a global order without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpwork.plans.shared import Stage


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Adds ``name``: the position from 0 of each row in ``order``, which must have no ties.

    Range partitions are sorted and numbered on their own; the numbers of rows of the partitions before each give its
    offset. The partitioned rows are written first, since the range bounds come from a sample.
    """
    stage = Stage(df.sparkSession, "order")
    parts = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    parts = stage.write(parts, "parts")
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    offset = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = sizes.select("__part", offset.alias("__before"))  # one row per partition
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return parts.withColumn("__within", within).join(F.broadcast(before), "__part").withColumn(name, (F.col("__before") + F.col("__within")).cast("long")).drop("__part", "__before", "__within")


def ranks_by_hash(df: DataFrame, keys: Sequence[str], hashed: str, name: str, bits: int = 12) -> DataFrame:
    """Adds ``name``: the position from 0 of each row among those with equal ``keys``, in the order of a hex hash column.

    Rows are counted per prefix of the hash, so a hot key is spread over 2**bits tasks' groups.
    """
    bucket = F.conv(F.substring(hashed, 1, bits // 4), 16, 10).cast("int")
    rows = df.withColumn("__bucket", bucket)
    counts = rows.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("__before", before).drop("__n")
    within = F.row_number().over(Window.partitionBy(*keys, "__bucket").orderBy(hashed)) - 1
    return rows.withColumn("__within", within).join(counts, [*keys, "__bucket"]).withColumn(name, (F.col("__before") + F.col("__within")).cast("long")).drop("__bucket", "__before", "__within")
