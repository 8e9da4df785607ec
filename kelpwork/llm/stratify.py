"""Assigning records to splits so that related records stay together.

Grouped iterative stratification: components of related records are found, their label vectors added up, and components
holding the rarest outstanding label are placed first, each into the split that needs this label most.

The placement itself is sequential, so it must see a bounded number of things whatever the number of records. Of each
label, components above 1/UNITS of its rows are placed one by one; the others, which have that label as their rarest,
are dealt by hash into UNITS bundles that are placed like components. So at most about 2 * UNITS things per label are
placed, in one task, and a bundle's weight bounds how far a label can miss its ratio.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpwork.llm.groups import linked_groups
from kelpwork.operators.allocate import check_ratios
from kelpwork.plans.shared import Stage

RATIOS = {"train": 0.70, "val": 0.15, "test": 0.15}
UNITS = 512
#: The label of records without one; they are held to the ratios as a label of their own.
NO_LABEL = ""


def components_of(rows: DataFrame, row_id: str, keys: Sequence[str]) -> DataFrame:
    """``(row_id, component)``: rows that share a value of any of ``keys``, directly or over other rows, share a component.

    A null key relates to nothing; a row without any key is a component of its own. With one key its value is the
    component; with several, the values are linked where they meet in a row, and the groups of values are solved.
    """
    own = F.concat(F.lit("row:"), F.col(row_id).cast("string"))
    value = lambda k: F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{k}:"), F.col(k).cast("string")))
    if len(keys) == 1:
        return rows.select(row_id, F.coalesce(value(keys[0]), own).alias("component"))
    first = F.coalesce(*[value(k) for k in keys])
    pairs = rows.select(first.alias("a"), F.explode(F.array_compact(F.array(*[value(k) for k in keys]))).alias("b")).distinct()
    groups = linked_groups(pairs, "a", "b").withColumnRenamed("name", "first")
    return rows.select(row_id, first.alias("first")).join(groups, "first", "left").select(row_id, F.coalesce("group_id", own).alias("component"))


def place(units: pd.DataFrame, ratios: Mapping[str, float]) -> pd.DataFrame:
    """Sequential placement of units given as rows ``(unit, label, n)``; returns ``(unit, assigned)``.

    While rows are outstanding: the label with fewest of them; its units by falling count of it, then by name; each goes
    to the split that lacks most rows of the label, then most rows at all, then the first of ``ratios``.
    """
    names = list(ratios)
    unit, order = pd.factorize(units["unit"], sort=True)
    label, labels = pd.factorize(units["label"], sort=True)
    n = units["n"].to_numpy(float)
    # entries by unit, and holders of each label; no table of all units by all labels
    by_unit = np.argsort(unit, kind="stable")
    unit_label, unit_n = label[by_unit], n[by_unit]
    first = np.r_[0, np.cumsum(np.bincount(unit, minlength=len(order)))]
    by_label = np.lexsort((unit, -n, label))
    holders = unit[by_label]
    begin = np.r_[0, np.cumsum(np.bincount(label, minlength=len(labels)))]
    outstanding = np.bincount(label, n, minlength=len(labels))
    lacks = np.array([ratios[s] for s in names])[:, None] * outstanding[None, :]
    open_, where = np.ones(len(order), bool), np.zeros(len(order), int)
    whole = lacks.sum(1)
    queue = [(x, k) for k, x in enumerate(outstanding.tolist())]
    heapq.heapify(queue)
    while queue:
        x, k = heapq.heappop(queue)
        if x != outstanding[k]:  # a later entry has the number that holds now
            continue
        changed = set()
        for u in holders[begin[k] : begin[k + 1]]:
            if not open_[u]:
                continue
            own, size = unit_label[first[u] : first[u + 1]], unit_n[first[u] : first[u + 1]]
            lack = lacks[:, k]
            best = np.flatnonzero(lack == lack.max())
            s = best[np.argmax(whole[best])]
            where[u], open_[u] = s, False
            lacks[s, own] -= size
            whole[s] -= size.sum()
            outstanding[own] -= size
            changed.update(own.tolist())
        for j in changed:
            if outstanding[j] > 0:
                heapq.heappush(queue, (float(outstanding[j]), j))
    return pd.DataFrame({"unit": order, "assigned": [names[i] for i in where]})


def grouped_split(rows: DataFrame, row_id: str, keys: Sequence[str], label: str, current: str | None = None, ratios: Mapping[str, float] = RATIOS, units: int = UNITS) -> DataFrame:
    """One row per component: ``(component, n_rows, n_current, assigned)``, with ``n_current`` the number of splits that
    its rows have in column ``current`` (null counts as none).

    ``label`` and ``current`` must have been read already. Rows repeated under one ``row_id`` count once; a null label is
    a label of its own; rows with a null ``row_id`` are left out. An empty table gives an empty result. Ratios must be
    no less than 0 and add up to 1. Join the result to ``components_of`` to have the split of each row.
    """
    check_ratios(ratios)
    if min(ratios.values()) < 0:
        raise ValueError(f"a ratio is negative: {dict(ratios)}")
    stage = Stage(rows.sparkSession, "stratify")
    narrow = rows.where(F.col(row_id).isNotNull()).select(
        F.col(row_id).alias("row_id"),
        *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)],
        F.coalesce(F.col(label), F.lit(NO_LABEL)).alias("label"),
        (F.col(current) if current else F.lit(None).cast("string")).alias("current"),
    )
    once = narrow.dropDuplicates(["row_id"])
    if len(keys) > 1:
        once = stage.write(once, "once")
        once = once.join(components_of(once, "row_id", [f"k{i}" for i in range(len(keys))]), "row_id")
    else:
        once = once.withColumn("component", F.coalesce(F.concat(F.lit("k:"), F.col("k0").cast("string")), F.concat(F.lit("row:"), F.col("row_id").cast("string"))))
    # one row per (component, label, current) and map task reaches the shuffle, so a hot component is no hot task
    cells = once.groupBy("component", "label", "current").agg(F.count(F.lit(1)).alias("n"))
    vectors = cells.groupBy("component", "label").agg(F.sum("n").alias("n"), F.collect_set("current").alias("current"))
    vectors = stage.write(vectors, "vectors")
    totals = vectors.groupBy("label").agg(F.sum("n").alias("total"))
    by_component = Window.partitionBy("component")  # at most one row per label
    rarest = F.min(F.struct("total", "label")).over(by_component)
    heavy = F.max(F.col("n") * units > F.col("total")).over(by_component)
    # labels may be many, so Spark decides by size how their totals are joined; a hot label holds no more rows here than components
    known = vectors.join(totals, "label").withColumns({"rarest": rarest, "heavy": heavy})
    bundle = F.concat(F.lit("b:"), F.col("rarest.label"), F.lit(":"), F.pmod(F.xxhash64("component"), F.lit(units)))
    known = known.withColumn("unit", F.when(F.col("heavy"), F.concat(F.lit("c:"), F.col("component"))).otherwise(bundle))
    known = stage.write(known.select("component", "label", "n", "current", "unit"), "known")
    bundles = known.groupBy("unit", "label").agg(F.sum("n").alias("n"))
    split_names = dict(ratios)
    placed = bundles.groupBy(F.lit(0).alias("all")).applyInPandas(lambda pdf: place(pdf[["unit", "label", "n"]], split_names), "unit string, assigned string")
    placed = stage.write(placed, "placed")
    whole = known.groupBy("component", "unit").agg(F.sum("n").alias("n_rows"), F.size(F.array_distinct(F.flatten(F.collect_list("current")))).alias("n_current"))
    return whole.join(placed, "unit").select("component", "n_rows", "n_current", "assigned")
