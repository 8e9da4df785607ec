"""Random splits and samples with exact counts, reproducible from seed and id alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpwork.functions.text import hash_order
from kelpwork.plans.order import numbered, ranks_by_hash
from kelpwork.plans.shared import Stage
from kelpwork.plans.skew import hot_lookup


def random_split(rows: DataFrame, row_id: str, label: str, fraction: float = 0.2, seed: int = 0, names: tuple[str, str] = ("train", "test"), single: str = "raise") -> DataFrame:
    """Adds ``split``: of N rows ceil(fraction * N) go to the second part, per class by largest remainder (of equal
    remainders the smaller label), within a class in hash order. Rows without a label are dropped.

    Raises if a class has fewer than two rows or a part fewer rows than there are classes. With ``single="first"`` classes
    of one row go to the first part instead and take no part in the quotas; only then may a part be small.
    """
    rows = rows.where(F.col(label).isNotNull())
    stage = Stage(rows.sparkSession, "sampling")
    every = stage.write(rows.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n")), "sizes")
    sizes = every if single == "raise" else every.where("n > 1")
    total, classes, least = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.min("n")).first()
    n_test = -(-round(fraction * total * 1e9) // 10**9)
    if single == "raise" and total and (least < 2 or n_test < classes or total - n_test < classes):
        raise ValueError(f"{total} rows of {classes} classes, smallest {least}, cannot be split into {total - n_test} and {n_test}")
    share = F.col("n") * F.lit(n_test) / F.lit(max(total, 1))
    quotas = sizes.withColumn("base", F.floor(share).cast("long")).withColumn("rest", share - F.floor(share))
    given = n_test - (quotas.agg(F.sum("base")).first()[0] or 0)
    # positions by range partitions, since labels are free text and may be many
    placed = numbered(quotas, [F.desc("rest"), F.col("label")], "pos")
    quotas = placed.select(F.col("label").alias(label), (F.col("base") + (F.col("pos") < given).cast("long")).alias("quota"))
    ranked = ranks_by_hash(rows.withColumn("__hash", hash_order(seed, F.col(row_id))), [label], "__hash", "__rank")
    quotas = stage.write(quotas, "quotas")
    met = hot_lookup(ranked, label, quotas, int(every.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]))
    return met.withColumn("split", F.when(F.col("__rank") < F.col("quota"), names[1]).otherwise(names[0])).drop("__hash", "__rank", "quota")


def sample_n(rows: DataFrame, row_id: str, n: int, seed: int = 0) -> DataFrame:
    """Exactly n rows, or all if there are fewer: the first in hash order (a top-n, not a sort)."""
    return rows.withColumn("__hash", hash_order(seed, F.col(row_id))).orderBy("__hash").limit(n).drop("__hash")


def per_class_k(rows: DataFrame, row_id: str, label: str, k: int = 20, seed: int = 0) -> DataFrame:
    """Up to k rows of each label, the first in hash order; map tasks keep only k per label."""
    rank = F.row_number().over(Window.partitionBy(label).orderBy("__hash"))
    return rows.where(F.col(label).isNotNull()).withColumn("__hash", hash_order(seed, F.col(row_id))).withColumn("__rank", rank).where(F.col("__rank") <= k).drop("__hash", "__rank")


def frame_checks(rows: DataFrame, label: str) -> DataFrame:
    """``(n_rows, n_labels)``; raises if there are no rows."""
    out = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(label).alias("n_labels"))
    if out.first()["n_rows"] == 0:
        raise ValueError("no rows")
    return out
