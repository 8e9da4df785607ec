"""Samples whose category shares follow given targets (cube method).

Every record of a category has the inclusion probability wanted / available. A flight phase moves pairs of undecided
records of one category against each other, in directions that keep the balancing equations (the category totals), with
chances that keep each record's expected inclusion; each move decides at least one of the two. The flight runs in
buckets of records; what a bucket leaves undecided, at most one record per category, merges upward through a tree of
buckets. At the root the landing phase moves the last records of all categories of a sample against each other, which
keeps the size of the sample, and decides the final one by its probability.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpwork.functions.text import label_of, split_of
from kelpwork.plans.shared import Stage

#: Records of a bucket of the first flight, and buckets that merge into one of the next.
BUCKET_ROWS = 200_000
FAN_IN = 16
EPS = 1e-9
STATE = "sample string, category string, row_id long, pi double, bucket int"


def _mixed(ids: np.ndarray, seed: int) -> np.ndarray:
    """64-bit mix of ids (splitmix): a fixed random order of records, whatever their partitioning."""
    with np.errstate(over="ignore"):
        z = ids.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def flight(pi: np.ndarray, group: np.ndarray, ids: np.ndarray, seed: int) -> np.ndarray:
    """Moves undecided records of each group pairwise until at most one per group is undecided; sums per group stay.

    All pairs of a turn move at once. A pair (a, b) moves to (a+b, 0) or (0, a+b) if a+b <= 1, else to (1, a+b-1) or
    (a+b-1, 1), with the chances that keep both expectations.
    """
    pi, turn = pi.astype(float).copy(), 0
    while True:
        at = np.flatnonzero((pi > EPS) & (pi < 1 - EPS))
        if at.size < 2:
            break
        noise = _mixed(ids[at], seed + 7919 * turn)
        at = at[np.lexsort((noise, group[at]))]
        g = group[at]
        start = np.r_[True, g[1:] != g[:-1]]
        place = np.arange(at.size) - np.maximum.accumulate(np.where(start, np.arange(at.size), 0))
        first = np.flatnonzero((place[:-1] % 2 == 0) & (g[:-1] == g[1:]))
        if first.size == 0:
            break
        i, j = at[first], at[first + 1]
        a, b = pi[i], pi[j]
        u = _mixed(ids[i] ^ (ids[j] << 1), seed + 104729 * (turn + 1)).astype(float) / 2.0**64
        total, low = a + b, a + b <= 1
        to_i = np.where(low, a / total, (1 - b) / np.where(low, 1, 2 - total))
        wins = u < to_i
        pi[i] = np.where(low, np.where(wins, total, 0), np.where(wins, 1, total - 1))
        pi[j] = np.where(low, np.where(wins, 0, total), np.where(wins, total - 1, 1))
        turn += 1
    return np.where(pi < EPS, 0.0, np.where(pi > 1 - EPS, 1.0, pi))


def _fly(pdf: pd.DataFrame, seed: int) -> pd.DataFrame:
    """Flight within one bucket; returns chosen (pi = 1) and undecided records."""
    group = pdf.groupby(["sample", "category"], sort=True).ngroup().to_numpy()
    pdf = pdf.assign(pi=flight(pdf["pi"].to_numpy(), group, pdf["row_id"].to_numpy(), seed))
    return pdf[pdf["pi"] > 0]


def _land(pdf: pd.DataFrame, seed: int) -> pd.DataFrame:
    """Flight within the categories, then across those of a sample; the last undecided record is decided by its pi."""
    pdf = _fly(pdf, seed)
    group = pdf.groupby("sample", sort=True).ngroup().to_numpy()
    ids = pdf["row_id"].to_numpy()
    pi = flight(pdf["pi"].to_numpy(), group, ids, seed + 1)
    u = _mixed(ids, seed + 2).astype(float) / 2.0**64
    return pdf.assign(pi=np.where((pi > 0) & (pi < 1), (u < pi).astype(float), pi)).query("pi > 0")


def _seeded(step, seed: int):
    return lambda pdf: step(pdf, seed)


class ProportionSample:
    """Draws the samples of all plans over ``rows`` (row_idx, label, split) and reports on them.

    ``targets`` has plan_id, split, label, target_share, min_rows, sample_size. Wanted of a category is the larger of
    min_rows and target_share * sample_size (a null part counts as 0); if fewer distinct ``row_idx`` are there, all are
    taken. Labels and splits are read without case and surrounding white space; rows without row_idx, label or split are
    in no category. Rows repeated under one ``row_idx`` count once. Targets repeated for one (plan, split, label) count
    by their largest wanted number. Empty tables give empty results.
    """

    def __init__(self, rows: DataFrame, targets: DataFrame, seed: int = 0, bucket_rows: int = BUCKET_ROWS):
        self.stage = Stage(rows.sparkSession, "cube")
        self.seed = seed
        read = rows.select(F.col("row_idx").cast("long").alias("row_id"), split_of(F.col("split")).alias("split"), label_of(F.col("label")).alias("label"))
        self.pool = self.stage.write(read.where("row_id IS NOT NULL AND split IS NOT NULL AND label IS NOT NULL").groupBy("row_id").agg(F.min(F.struct("split", "label")).alias("c")).select("row_id", "c.split", "c.label"), "pool")
        wanted = F.greatest(F.coalesce(F.col("min_rows").cast("double"), F.lit(0.0)), F.coalesce(F.col("target_share") * F.col("sample_size"), F.lit(0.0)))
        goals = targets.select("plan_id", F.col("split").alias("split0"), F.col("label").alias("label0"), split_of(F.col("split")).alias("split"), label_of(F.col("label")).alias("label"), "target_share", "min_rows", "sample_size", wanted.alias("wanted"))
        available = self.pool.groupBy("split", "label").agg(F.count(F.lit(1)).alias("available"))
        goals = goals.join(available, ["split", "label"], "left").na.fill(0, ["available"])
        self.goals = self.stage.write(goals.withColumn("pi", F.when(F.col("available") > 0, F.least(F.lit(1.0), F.col("wanted") / F.col("available"))).otherwise(0.0)), "goals")
        self.chosen = self._draw(bucket_rows)

    def _draw(self, bucket_rows: int) -> DataFrame:
        """``(sample, category, row_id)``: sample is plan and split, category its label."""
        buckets = max(1, -(-self.pool.count() // bucket_rows))
        sample = F.concat_ws(":", F.col("plan_id").cast("string"), "split")
        pi = self.goals.where("split IS NOT NULL AND label IS NOT NULL AND plan_id IS NOT NULL").groupBy("plan_id", "split", "label").agg(F.max("pi").alias("pi")).where("pi > 0")
        bucket = F.pmod(F.xxhash64(F.lit(self.seed), "row_id"), F.lit(buckets)).cast("int").alias("bucket")
        states = lambda some: self.pool.join(pi.where(some), ["split", "label"]).select(sample.alias("sample"), F.col("label").alias("category"), "row_id", "pi", bucket)
        # categories that are taken whole never enter a flight; several plans share a bucket's records but not their flights
        open_, level, parts = states("pi < 1"), 0, [states("pi >= 1").select("sample", "category", "row_id")]
        while True:
            last = buckets == 1
            step = _seeded(_land if last else _fly, self.seed + 1_000_003 * level)
            flown = self.stage.write(open_.groupBy("sample", "bucket").applyInPandas(step, STATE), f"level{level}")
            parts.append(flown.where("pi = 1").select("sample", "category", "row_id"))
            if last:
                break
            buckets, level = -(-buckets // FAN_IN), level + 1
            open_ = flown.where("pi < 1").withColumn("bucket", F.floor(F.col("bucket") / FAN_IN).cast("int"))
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        return out

    def sample(self) -> DataFrame:
        """``(plan_id, split, label, row_idx)``."""
        at = F.split("sample", ":")
        return self.chosen.select(F.get(at, F.lit(0)).cast("long").alias("plan_id"), F.get(at, F.lit(1)).alias("split"), F.col("category").alias("label"), F.col("row_id").alias("row_idx"))

    def report(self) -> DataFrame:
        """Per target: wanted, available, sampled, residual (sampled - wanted), achieved share, and whether it fell short.

        ``short`` is true where fewer records exist than wanted; then all of them are in the sample.
        """
        drawn = self.sample().groupBy("plan_id", "split", "label").agg(F.count(F.lit(1)).alias("sampled"))
        sizes = drawn.groupBy("plan_id", "split").agg(F.sum("sampled").alias("drawn"))
        out = self.goals.join(drawn, ["plan_id", "split", "label"], "left").join(sizes, ["plan_id", "split"], "left").na.fill(0, ["sampled", "drawn"])
        return out.select(
            "plan_id", F.col("split0").alias("split"), F.col("label0").alias("label"), "target_share", "min_rows", "sample_size", "wanted", "available", "sampled",
            (F.col("sampled") - F.col("wanted")).alias("residual"),
            F.when(F.col("drawn") > 0, F.col("sampled") / F.col("drawn")).alias("achieved_share"),
            ((F.col("available") < F.col("wanted")) & (F.col("sampled") == F.col("available"))).alias("short"),
        )
