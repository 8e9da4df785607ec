import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kelpwork.operators import hotkeys
from kelpwork.operators.compaction import Consolidation, freeze_manifest, plan_groups
from kelpwork.plans.shared import Stage, released, exists
from kelpwork.plans.skew import blocked_join, hot_counts, hot_lookup
from kelpwork.sources.index_csv import index_records


def quantile(values, q):
    values = sorted(values)
    return values[max(1, -int(-q * len(values) // 1)) - 1]


@pytest.mark.parametrize("broadcast", [50_000, -1])
def test_quantiles(spark, monkeypatch, broadcast):
    monkeypatch.setattr(hotkeys, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(hotkeys, "HOT_ROWS", 100)
    r = random.Random(1)
    rows = [("hot", r.choice([5, 5, r.randrange(-10**12, 10**12)]), "x") for _ in range(2000)] + [(f"k{i % 50}", r.randrange(1000), "y") for i in range(300)] + [("same", 7, "z")] * 40 + [(None, 1, "n"), ("null", None, "n"), ("same", None, "z")]
    df = spark.createDataFrame(rows, "id string, v long, salt string")
    held = {}
    for k, v, _ in rows:
        if k is not None and v is not None:
            held.setdefault(k, []).append(v)
    found = hotkeys.KeyQuantiles(df, "id", "v", [0.0, 0.25, 0.5, 0.9, 1.0], hotkeys.Stage(spark, "t"))
    got = found.result.collect()
    assert {x.key: x.n_rows for x in found.rows.collect()} == Counter(k for k, _, _ in rows if k is not None)
    assert {(x.key, x.q): x.value for x in got} == {(k, q): quantile(v, q) for k, v in held.items() for q in (0.0, 0.25, 0.5, 0.9, 1.0)}
    assert len(got) == 5 * len(held)


def test_profile_edges(spark):
    schema = "cluster_id long, l string, s string, v long, key string, n long"
    empty = spark.createDataFrame([], schema)
    assert hotkeys.key_profile(empty, "cluster_id", "l", "s", "v").count() == 0 and hotkeys.hot_keys(hotkeys.key_profile(empty, "cluster_id", "l", "s", "v")).count() == 0
    df = spark.createDataFrame([(1, "a", "train", 3, "k", 1), (1, None, None, None, "k", 1), (1, "a", "val", 9, "k", 1), (None, "b", "val", 1, "k", 1), (2, None, "test", None, "k", 1)], schema)
    got = {r.key: tuple(r)[1:] for r in hotkeys.key_profile(df, "cluster_id", "l", "s", "v").collect()}
    assert got == {1: (3, 1, 1, 1, 0, 3, 3, 9), 2: (1, 0, 0, 0, 1, None, None, None)}


def test_records(spark):
    texts = {
        0: '﻿image_path,label,cluster_id\r\n"a,b",x,1\r\n\r\nc,y,2', 1: 'label,cluster_id,image_path\nx,3,"q""uote"\n', 2: "p,l,4\np,l\nonly\n,,\n", 3: '"m\nn",l,5\n"cut', 4: "", 5: None,
        6: 'z,"l",6\r"a","b","4', 7: "image_path,label,cluster_id", 8: "x" * 200_000 + ",l,1\n" + "y,l,2\n" * 3000,
    }
    files = spark.createDataFrame(list(texts.items()), "file_id long, content string")
    got = sorted((r.file_id, r.rec_no, r.image_path, r.label, r.cluster_id) for r in index_records(files).where("file_id < 8").collect())
    assert got == [(0, 1, "a,b", "x", "1"), (0, 2, "c", "y", "2"), (1, 1, 'q"uote', "x", "3"), (2, 1, "p", "l", "4"), (2, 2, "", "", ""), (3, 1, "m\nn", "l", "5"), (6, 1, "z", "l", "6")]
    assert index_records(files).where("file_id = 8").count() == 3001


def test_consolidation(spark):
    schema = "file_id long, file_path string, n_bytes long, content string, group_id long"
    rows = [(i, f"f{i}", 100, f"p{i},l,1\np{i % 3},l,2\n", 9) for i in range(20)]
    c = Consolidation(spark.createDataFrame(rows + rows[:4] + [(None, "x", 1, "a,b,c", 0), (50, "y", None, None, 0)], schema), 450)
    assert sorted((r.file_id, r.starts_at, r.group_id) for r in c.groups.collect()) == [(i, 100 * i, 100 * i // 450) for i in range(20)] + [(50, 2000, 4)]
    back = c.written
    assert sorted(r.image_path for r in back.collect()) == sorted(f"p{i}" for i in range(20))
    assert c.repeated().count() == 20 and c.report().agg(F.sum("n_records"), F.sum("n_kept")).first() == (40, 20)
    assert all(len(f["group_id"].unique()) == 1 for f in (pd.read_parquet(x) for x in back.inputFiles()) if len(f))  # a file per group
    empty = Consolidation(spark.createDataFrame([], schema))
    assert empty.repeated().count() == 0 and empty.written.count() == 0


def test_plan_of_sparse_ids(spark):
    """Sparse and negative ids: blocks are range partitions, and no window over files lacks partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    r = random.Random(5)
    files = [(i, f"f{i}", (i * 37) % 90, "p,l,1") for i in r.sample(range(-(10**17), 10**17), 500)]
    manifest = freeze_manifest(spark.createDataFrame(files, "file_id long, path string, n_bytes long, content string"), Stage(spark, "t"))
    assert 1 < manifest.select("block").distinct().count() < 50
    plan = plan_groups(manifest, 100)
    at, want = 0, {}
    for i, _, n, _ in sorted(files):
        want[i], at = at, at + n
    assert {x.file_id: x.starts_at for x in plan.collect()} == want
    text = plan._jdf.queryExecution().executedPlan().toString()
    windows = [x for x in text.splitlines() if "Window [" in x and ", [file_id#" in x]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert windows and all(", [block#" in x for x in windows)


def test_copies_of_a_file(spark):
    rows = [(1, 10, "p,l,1\nq,l,2\n"), (1, 10, "p,l,1\nq,l,2\n"), (1, 10, None), (2, 10, "p,l,3"), (3, 5, "x,l,1"), (3, 5, "y,l,1")]
    c = Consolidation(spark.createDataFrame(rows, "file_id long, n_bytes long, content string"))
    assert sorted((r.file_id, r.rec_no) for r in c.repeated().collect()) == [(2, 1)]
    kept = {r.image_path: (r.file_id, r.rec_no, r.cluster_id) for r in c.written.collect()}
    assert len(kept) == 3 and kept["p"] == (1, 1, 1) and kept["q"] == (1, 2, 2)  # of file 3 one of the two contents holds


def test_hot_lookup(spark, monkeypatch):
    monkeypatch.setattr("kelpwork.plans.skew.HOT_ROWS", 20)
    big = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 7}") for i in range(200)] + [(999, None)], "i long, k string")
    small = spark.createDataFrame([("hot", 1), ("k0", 2), ("k1", 3)], "k string, v long")
    for how in ("left", "inner"):
        want = sorted(map(tuple, big.join(small, "k", how).select("i", "k", "v").collect()), key=str)
        assert sorted(map(tuple, hot_lookup(big, "k", small, 201, how).select("i", "k", "v").collect()), key=str) == want


def test_hot_counts(spark):
    df = spark.createDataFrame([("a", i % 2, i) for i in range(60)] + [(None, 1, i) for i in range(50)] + [(f"k{i}", 0, i) for i in range(30)], "k string, g int, i int")
    assert [tuple(r) for r in hot_counts(df, ["k"], 40).collect()] == [("a", 60)]
    assert sorted(tuple(r) for r in hot_counts(df, ["k", "g"], 20).collect()) == [("a", 0, 30), ("a", 1, 30)]
    assert hot_counts(df, ["k"], 60) is None and hot_counts(df.where("false"), ["k"], 1) is None


def test_blocked_join(spark):
    a = spark.createDataFrame([(("hot" if i % 3 else "k") if i else None, i) for i in range(90)], "k string, a int")
    b = spark.createDataFrame([("hot" if i % 2 else "k", i) for i in range(70)], "k string, b int")
    want = sorted(map(tuple, a.join(b, "k").collect()))
    assert sorted(map(tuple, blocked_join(a, b, ["k"], "a", "b", 8).collect())) == want == sorted(map(tuple, blocked_join(a, b, ["k"], "a", "b").collect()))


def test_stages_are_removed(spark):
    with released():
        stage = Stage(spark, "t")
        table, n = stage.counted(spark.range(7), "x")
        assert n == 7 == table.count() and exists(spark, f"{stage.root}/x")
    assert not exists(spark, stage.root)
