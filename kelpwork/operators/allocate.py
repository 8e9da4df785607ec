"""Class-stratified greedy allocation of whole clusters to splits, and the check that no cluster spans two.

The rule is sequential: per class, clusters by falling size and random order; each goes to the split that lacks most
rows (target - assigned, first of equal ones). Its state changes with every cluster, but clusters of one size are
interchangeable: while m clusters of size n are placed, split i's j-th of them has the priority deficit_i - n * (j - 1),
and the m largest priorities are taken in order. So the state is carried over the distinct sizes of a class only, of
which N rows have fewer than sqrt(2 N), and each cluster finds its split from its rank among those of its size.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpwork.functions.text import hash_order
from kelpwork.plans.order import numbered, ranks_by_hash
from kelpwork.plans.skew import hot_lookup

RATIOS = {"train": 0.70, "val": 0.15, "test": 0.15}


def check_ratios(ratios: Mapping[str, float]) -> None:
    if abs(sum(ratios.values()) - 1) > 1e-6:
        raise ValueError(f"ratios add up to {sum(ratios.values())}, not 1")


def cluster_summary(rows: DataFrame, cluster: str = "cluster_id", label: str = "label") -> DataFrame:
    """``(cluster_id, n, dominant_label)``: rows, and the most frequent label, of equal ones the smallest.

    Rows with a null cluster are dropped; null labels count as rows only, a cluster with no other label has a null one.
    Counts per (cluster, label) are merged first, so a hot cluster is no hot task.
    """
    cells = rows.where(F.col(cluster).isNotNull()).groupBy(F.col(cluster).alias("cluster_id"), F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.when(F.col("label").isNotNull(), F.struct((-F.col("n")).alias("m"), "label")))
    return cells.groupBy("cluster_id").agg(F.sum("n").alias("n"), best["label"].alias("dominant_label"))


def greedy_choice(targets: np.ndarray, assigned: np.ndarray, size: np.ndarray, done: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State of rows of splits after ``done`` clusters of ``size``, and the split of the next one (rows x splits arrays).

    A lower bound of what each split has taken comes from levelling the deficits; the few clusters left are placed one
    by one with the very comparisons of the sequential rule.
    """
    lack = targets - assigned
    falling = -np.sort(-lack, axis=1)
    k = lack.shape[1]
    level = (np.cumsum(falling, axis=1) - (size * done)[:, None]) / np.arange(1, k + 1)
    after = np.column_stack([falling[:, 1:], np.full(len(lack), -np.inf)])
    level = level[np.arange(len(lack)), np.argmax(level >= after, axis=1)]
    taken = np.maximum(0, np.floor((lack - level[:, None]) / size[:, None]) - 2)
    left = done - taken.sum(1)
    while (left > 0).any():
        pick = np.argmax(targets - (assigned + size[:, None] * taken), axis=1)
        taken[np.arange(len(lack)), pick] += left > 0
        left = left - (left > 0)
    state = assigned + size[:, None] * taken
    return state, np.argmax(targets - state, axis=1)


def _run_starts(ratios: np.ndarray):
    """Per class: the state before each run of clusters of one size."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n", ascending=False)
        targets = ratios[None, :] * float((pdf["n"] * pdf["m"]).sum())
        state, starts = np.zeros((1, len(ratios))), []
        for n, m in zip(pdf["n"].to_numpy(float), pdf["m"].to_numpy(float)):
            starts.append(state[0])
            state, _ = greedy_choice(targets, state, np.array([n]), np.array([m]))
        return pd.DataFrame({"run": pdf["run"], "targets": [targets[0]] * len(pdf), "starts": starts})

    return fold


def _uniforms(seed: int):
    """The pos-th draw of numpy's default generator, as sortable hex digits; each batch jumps to its first position."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            pos = pdf["pos"].to_numpy()
            out = np.empty(len(pos), np.uint64)
            order = np.argsort(pos)
            for block in np.split(order, np.flatnonzero(np.diff(pos[order]) != 1) + 1):
                bits = np.random.default_rng(seed).bit_generator
                bits.advance(int(pos[block[0]]))
                out[block] = bits.random_raw(len(block)) >> np.uint64(11)
            yield pdf.drop(columns="pos").assign(tie=[f"{int(x) << 3:014x}" for x in out])

    return run


def allocate(clusters: DataFrame, ratios: Mapping[str, float] = RATIOS, seed: int = 0, stratify: bool = True, generator: str = "md5") -> DataFrame:
    """``(cluster_id, split)`` for ``(cluster_id, n, dominant_label)``.

    Clusters of equal size are ordered by the md5 of seed and id, or, with ``generator="pcg64"``, by one uniform per
    cluster from numpy's default generator, drawn by class (in order of the smallest id) and id. The order of ``ratios``
    decides ties. Raises if ratios do not add up to 1, or if a cluster has no label while stratifying.
    """
    check_ratios(ratios)
    names = list(ratios)
    if stratify and not clusters.where("dominant_label IS NULL").isEmpty():
        raise ValueError("a cluster has no label")
    rows = clusters.select("cluster_id", "n", (F.col("dominant_label") if stratify else F.lit("")).alias("class"))
    if generator == "pcg64":
        first = rows.groupBy("class").agg(F.min("cluster_id").alias("first"))
        placed = numbered(hot_lookup(rows, "class", first, rows.count(), "inner"), [F.col("first"), F.col("cluster_id")], "pos").drop("first")
        types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema if f.name != "pos")
        rows = placed.mapInPandas(_uniforms(seed), f"{types}, tie string")
    else:
        rows = rows.withColumn("tie", hash_order(seed, F.col("cluster_id")))
    rows = rows.withColumn("run", F.concat_ws(":", F.col("n").cast("string"), "class"))
    runs = rows.groupBy("class", "n", "run").agg(F.count(F.lit(1)).alias("m"))
    starts = runs.groupBy("class").applyInPandas(_run_starts(np.array([float(ratios[s]) for s in names])), "run string, targets array<double>, starts array<double>")
    ranked = hot_lookup(ranks_by_hash(rows, ["run"], "tie", "rank"), "run", starts, rows.count(), "inner")

    @F.pandas_udf("int")
    def pick(targets: pd.Series, starts: pd.Series, n: pd.Series, rank: pd.Series) -> pd.Series:
        if not len(n):
            return pd.Series([], dtype="int32")
        return pd.Series(greedy_choice(np.vstack(targets), np.vstack(starts), n.to_numpy(float), rank.to_numpy(float))[1].astype("int32"))

    return ranked.select("cluster_id", F.element_at(F.array(*map(F.lit, names)), pick("targets", "starts", "n", "rank") + 1).alias("split"))


def with_split(rows: DataFrame, assignment: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Left join of each row to its cluster's split; null if the cluster is null or unknown. Hot clusters are looked up apart."""
    return hot_lookup(rows.drop("split"), cluster, assignment.withColumnRenamed("cluster_id", cluster), rows.count())


def leaking_clusters(rows: DataFrame, cluster: str = "cluster_id", split: str = "split") -> DataFrame:
    """``(cluster_id, n_splits)`` of clusters with rows in more than one split; null clusters and splits do not count."""
    cells = rows.where(F.col(cluster).isNotNull() & F.col(split).isNotNull()).select(F.col(cluster).alias("cluster_id"), F.col(split).alias("split")).distinct()
    return cells.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_splits")).where("n_splits > 1")


def assert_no_leakage(rows: DataFrame, cluster: str = "cluster_id", split: str = "split") -> None:
    bad = leaking_clusters(rows, cluster, split)
    first = [r[0] for r in bad.orderBy("cluster_id").limit(5).select("cluster_id").collect()]
    if first:
        raise AssertionError(f"{bad.count()} clusters stand in more than one split, first {first}")
