"""Figures of a split table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPLITS = ("train", "val", "test")


def cluster_stats(rows: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """One row: clusters, those of more than one row, rows in them, their percentage of all rows, largest. Zeros if empty."""
    sizes = rows.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n")
    held = sizes.agg(
        F.count(cluster).alias("n_clusters"),
        F.count_if(F.col(cluster).isNotNull() & (F.col("n") > 1)).alias("n_multiple"),
        F.coalesce(F.sum(F.when(F.col(cluster).isNotNull() & (F.col("n") > 1), F.col("n"))), F.lit(0)).alias("rows_multiple"),
        F.coalesce(F.max(F.when(F.col(cluster).isNotNull(), F.col("n"))), F.lit(0)).alias("largest"),
        F.coalesce(total, F.lit(0)).alias("n_rows"),
    )
    return held.withColumn("percent", 100.0 * F.col("rows_multiple") / F.greatest(F.col("n_rows"), F.lit(1)))


def split_totals(rows: DataFrame, split: str = "split", splits: Sequence[str] = SPLITS) -> DataFrame:
    """``(split, n, percent)`` for each of ``splits``, 0 if absent; the percentage is of all rows."""
    counts = rows.groupBy(F.col(split).alias("split")).agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.greatest(F.count(F.lit(1)), F.lit(1))).first()[0]
    fixed = rows.sparkSession.createDataFrame([(s,) for s in splits], "split string")
    return fixed.join(counts, "split", "left").select("split", F.coalesce("n", F.lit(0)).alias("n"), (100.0 * F.coalesce("n", F.lit(0)) / F.lit(total)).alias("percent"))


def label_split_pivot(rows: DataFrame, label: str = "label", split: str = "split", splits: Sequence[str] = SPLITS) -> DataFrame:
    """Rows per label and split with fixed columns, and their sum; rows of other splits count in none. Null labels are dropped."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(*[F.count_if(F.col(split) == s).alias(s) for s in splits])
    return counts.withColumn("total", sum((F.col(s) for s in splits[1:]), F.col(splits[0])))


def text_report(title: str, header: dict[str, object], stats: dict[str, object], totals: Sequence, pivot: Sequence, warnings: Sequence[str], leaks: int) -> str:
    """The report as text; it gets figures only. ``pivot`` has one row per label."""
    lines = [title, "", *[f"{k}: {v}" for k, v in header.items()], *[f"warning: {w}" for w in warnings], ""]
    lines += ["clusters", *[f"  {k}: {v}" for k, v in stats.items()], "", "splits"]
    lines += [f"  {r['split']:<8}{r['n']:>10}  {r['percent']:.1f}%" for r in totals]
    lines += ["", "labels by split"]
    lines += [f"  {r['label']:<16}" + "".join(f"{r[s]:>10}" for s in (*SPLITS, "total")) for r in pivot]
    return "\n".join([*lines, "", f"leakage: {'none' if leaks == 0 else f'{leaks} clusters in more than one split'}"])
