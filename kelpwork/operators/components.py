"""Connected components and dense cluster ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpwork.plans.order import numbered
from kelpwork.plans.shared import Stage
from kelpwork.plans.skew import hot_lookup

MAX_ROUNDS = 100


def components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: list[int] | None = None) -> DataFrame:
    """``(id, component)`` of every vertex that has an edge; component is the smallest id of its component.

    Large-star and small-star rounds: each vertex hands its larger neighbours, then its smaller ones, to the smallest
    vertex around it, until every vertex is linked to its component's smallest and to nothing else. Tables are written
    between rounds; hot vertices are looked up apart. ``rounds`` is given how many there were.
    """
    stage = Stage(edges.sparkSession, "components")
    pairs = edges.select(F.greatest(src, dst).alias("hi"), F.least(src, dst).alias("lo")).where("hi <> lo").distinct()
    pairs, n_pairs = stage.counted(pairs, "0")
    mark = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")))
    state = None
    for turn in range(1, MAX_ROUNDS + 1):
        ways = pairs.select(F.col("hi").alias("x"), F.col("lo").alias("y")).unionAll(pairs.select(F.col("lo").alias("x"), F.col("hi").alias("y")))
        least = ways.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = hot_lookup(ways.where("y > x"), "x", least, n_pairs).select(F.col("y").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        large, n_large = stage.counted(large, f"large{turn}")
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = hot_lookup(large, "hi", least, n_large)
        small = small.select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.hi", "e.lo").where("hi <> lo").distinct()
        pairs, now = stage.counted(small, str(turn), mark)
        stage.drop(f"large{turn}")
        if now == state:
            break
        stage.drop(str(turn - 1))
        state, n_pairs = now, now[0]
    else:
        raise ValueError(f"no fixed point after {MAX_ROUNDS} rounds")
    if rounds is not None:
        rounds.append(turn)
    roots = pairs.select(F.col("lo").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return pairs.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionByName(roots)


def cluster_ids(prints: DataFrame, reps: DataFrame, edges: DataFrame, row: str = "row_idx", code: str = "fp") -> DataFrame:
    """``(row_idx, cluster_id)`` of rows with a code: ids are dense from 0 in the order of each cluster's first row."""
    found = components(edges)
    of_rep = reps.select("fp", "rep").join(found.select(F.col("id").alias("rep"), "component"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component"))
    dense = numbered(of_rep.select("component").distinct(), [F.col("component")], "cluster_id")
    of_code = of_rep.join(dense, "component").select("fp", "cluster_id")
    rows = prints.where(F.col(code).isNotNull()).select(F.col(row).alias("row_idx"), F.col(code).alias("fp"))
    return hot_lookup(rows, "fp", of_code, rows.count()).select("row_idx", "cluster_id")
