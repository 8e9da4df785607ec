"""One identifier for all records linked directly or indirectly.

While a graph has vertices of degree one or two, every round strips the leaves and contracts an independent set of the
degree-two vertices (list ranking of chains by random priorities, so a chain of n vertices is gone in O(log n) rounds).
The core that is left is solved by star contraction, in which the vertices of locally lowest random rank are heads. Each removed vertex points to a neighbour that
outlived it; pointer jumping over this forest, O(log rounds) joins, gives every removed vertex its label back.

Every shuffle is keyed by an edge, by a vertex with map-side counts, or goes through ``hot_lookup``: a hub that is linked
to a third of all records never has its edges in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpwork.plans.shared import Stage
from kelpwork.plans.skew import hot_counts, hot_limit, hot_lookup

#: Stripping goes on while a round removes at least this part of the vertices.
WORTH = 0.05
MAX_ROUNDS = 200


def _hashed(name: Column | str, seed: int) -> Column:
    return F.xxhash64(name, F.lit(seed))


def _ids(names: DataFrame, stage: Stage) -> tuple[DataFrame, int, DataFrame | None]:
    """``(name, id)`` with ids that no two names share, the number of names, and the names whose id is not their first hash.

    Ids are 64-bit hashes. Of n names some n ** 2 / 2 ** 65 pairs share one (11 at 2 * 10 ** 10 names); only these names
    take a hash of the next seed, again and again until all ids differ.
    """
    first, n = stage.counted(names.select("name", _hashed("name", 0).alias("id"), F.lit(0).alias("turn")), "ids0")
    ids, moved, turn = first, None, 0
    while True:
        shared = ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
        met = ids.join(shared, "id").where(F.col("turn") == turn).select("name")
        met, n_met = stage.counted(met, f"met{turn}")
        if n_met == 0:
            return ids.select("name", "id"), n, moved
        turn += 1
        again = met.select("name", _hashed("name", turn).alias("id"), F.lit(turn).alias("turn"))
        moved = again if moved is None else moved.join(met, "name", "left_anti").unionByName(again)
        moved = stage.write(moved, f"moved_ids{turn}")
        ids = stage.write(first.join(moved, "name", "left_anti").unionByName(moved), f"ids{turn}")


def _by_id(links: DataFrame, moved: DataFrame | None) -> DataFrame:
    """Links by id. ``moved`` holds a handful of names, so Spark broadcasts it; a larger one it would shuffle."""
    out = links.select("a", "b", _hashed("a", 0).alias("p"), _hashed("b", 0).alias("q"))
    if moved is not None:
        for name, at in (("a", "p"), ("b", "q")):
            out = out.join(moved.select(F.col("name").alias(name), F.col("id").alias("other")), name, "left").withColumn(at, F.coalesce("other", at)).drop("other")
    return out.select(*_edge("p", "q"))


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))


def _edge(a: str, b: str) -> list:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def _strip(edges: DataFrame, seed: int) -> DataFrame:
    """``(x, n, lo, hi)``: leaves, and degree-two vertices of locally highest priority; no two of them are neighbours.

    The group of an edge has at most two rows, one per end of low degree.
    """
    degree = _both_ways(edges).groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("lo"), F.max("y").alias("hi"))
    low = degree.where("n <= 2").withColumn("y", F.explode(F.array_distinct(F.array("lo", "hi"))))
    rank = F.struct((F.col("n") == 1).alias("leaf"), F.xxhash64("x", F.lit(seed)).alias("priority"), "x", "n")
    tops = low.select(*_edge("x", "y"), rank.alias("rank")).groupBy("u", "v").agg(F.max("rank").alias("top"))
    won = tops.select("top.x", "top.n", (F.when(F.col("u") == F.col("top.x"), F.col("v")).otherwise(F.col("u"))).alias("y"))
    return won.groupBy("x", "n").agg(F.count(F.lit(1)).alias("wins"), F.min("y").alias("lo"), F.max("y").alias("hi")).where("wins = n").drop("wins")


def _without(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Edges without those of removed vertices, and with a short cut over each one of degree two, each once: in one shuffle."""
    two = removed.where("n = 2")
    kinds = [(edges.select("u", "v"), 0), (removed.select(*_edge("x", "lo")), 1), (two.select(*_edge("x", "hi")), 1), (two.select(*_edge("lo", "hi")), 2)]
    rows = None
    for part, kind in kinds:
        part = part.select("u", "v", F.lit(kind == 1).alias("gone"), F.lit(kind == 2).alias("cut"))
        rows = part if rows is None else rows.unionAll(part)
    return rows.groupBy("u", "v").agg(F.max("gone").alias("gone"), F.max("cut").alias("cut")).where("cut OR NOT gone").select("u", "v")


def _relabel(edges: DataFrame, side: str, moved: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """Replaces an end that moved. Hubs never move, so their edges take no part in the shuffle."""
    other = "v" if side == "u" else "u"
    to = moved.select(F.col("x").alias(side), F.col("lo").alias("to"))
    join = lambda e: e.join(to, side, "left").select(F.coalesce("to", side).alias(side), other)
    if hubs is None:
        return join(edges)
    hub = F.broadcast(hubs.select(F.col("x").alias(side)))
    return join(edges.join(hub, side, "left_anti")).unionByName(edges.join(hub, side, "left_semi").select(side, other))


def _contract_stars(edges: DataFrame, n_edges: int, seed: int, stage: Stage) -> tuple[DataFrame, int, DataFrame]:
    """``(moved, how many, edges)``: a vertex moves to its neighbour of lowest rank where that is a head, of lower rank than
    all around it. So heads never move, and the lowest of all draws in all around it. Hubs are always heads."""
    limit = hot_limit(stage.spark, n_edges)
    hubs = None
    if n_edges > limit:
        # degrees add up to two per edge, so hubs are far fewer than the limit, and no hubs any more once all others are contracted
        hubs = hot_counts(_both_ways(edges), ["x"], limit)
        hubs = None if hubs is None else stage.write(hubs.select("x"), f"hubs{seed}")
    rank = lambda c: F.xxhash64(F.lit(seed), c)  # of one number a bijection, so ranks are names as well
    nearest = _both_ways(edges).groupBy("x").agg(F.min(rank("y")).alias("best")).withColumn("own", rank("x"))
    if hubs is None:
        nearest = nearest.withColumn("hub", F.lit(False))
    else:
        nearest = nearest.join(F.broadcast(hubs.withColumn("hub", F.lit(True))), "x", "left").na.fill(False, ["hub"])
    heads = nearest.where("own < best OR hub").select(F.col("own").alias("best"), F.col("x").alias("lo"))
    tails = nearest.where("own > best AND NOT hub").select("x", "best")
    moved, n_moved = stage.counted(hot_lookup(tails, "best", heads, 2 * n_edges, "inner").select("x", "lo"), f"moved{seed}")
    left = _relabel(_relabel(edges, "u", moved, hubs), "v", moved, hubs)
    return moved, n_moved, left.where("u <> v").select(*_edge("u", "v")).distinct()


def _roots(parents: DataFrame, rows: int, stage: Stage) -> DataFrame:
    """``(id, root)`` of every removed vertex, by pointer jumping."""
    turn = 0
    while True:
        step = parents.select(F.col("id").alias("root"), F.col("root").alias("next"))
        jumped = hot_lookup(parents, "root", step, rows).select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        jumped, n_moved = stage.counted(jumped, f"jump{turn}", F.count_if("moved"))
        parents, turn = jumped.select("id", "root"), turn + 1
        if n_moved == 0:
            return parents


def linked_groups(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``(name, group_id)`` of every name in ``pairs``: group_id is the smallest name (by UTF-8 bytes) of its group.

    Pairs with a null side are left out; pairs may repeat and come in either order; a name linked only with itself is a
    group of one. An empty table gives an empty result.
    """
    stage = Stage(pairs.sparkSession, "groups")
    links = pairs.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    links = stage.write(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    ids, n_names, moved_ids = _ids(links.select(F.explode(F.array("a", "b")).alias("name")).distinct(), stage)
    edges, n_edges = stage.counted(_by_id(links.where("a <> b"), moved_ids), "edges0")
    parents, n_removed, strip = [], 0, True
    for turn in range(1, MAX_ROUNDS + 1):
        if n_edges == 0:
            break
        if strip:
            moved, n_moved = stage.counted(_strip(edges, turn), f"moved{turn}")
            rest = _without(edges, moved)
        else:
            moved, n_moved, rest = _contract_stars(edges, n_edges, turn, stage)
        parents.append(moved.select(F.col("x").alias("id"), F.col("lo").alias("root")))
        edges, n_edges = stage.counted(rest, f"edges{turn}")
        stage.drop(f"edges{turn - 1}")
        n_removed += n_moved
        strip = strip and n_moved >= WORTH * max(n_names - n_removed, 1)
    else:
        raise ValueError(f"{n_edges} edges are left after {MAX_ROUNDS} rounds")
    if not parents:
        return ids.select("name", F.col("name").alias("group_id"))
    forest = parents[0]
    for more in parents[1:]:
        forest = forest.unionByName(more)
    rooted = _roots(forest, n_removed, stage)
    # a root is a vertex that was never removed
    named = stage.write(ids.join(rooted, "id", "left").select("name", F.coalesce("root", "id").alias("root")), "named")
    smallest = named.groupBy("root").agg(F.min("name").alias("group_id"))
    return hot_lookup(named, "root", smallest, n_names).select("name", "group_id")
