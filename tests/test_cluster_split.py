import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpwork.operators import allocate, components, lsh, report


def codes(spark, values):
    return spark.createDataFrame([(i, None if v is None else bytes.fromhex(v) + bytes(2)) for i, v in enumerate(values)], "row_idx long, fp binary")


def clustered(spark, values, threshold, num_bands):
    prints = codes(spark, values)
    reps = lsh.representatives(prints)
    # of the four bytes only the first 16 bits are the code's
    edges = lsh.near_edges(reps, threshold, num_bands, 16)
    return [r.cluster_id for r in components.cluster_ids(prints, reps, edges).orderBy("row_idx").collect()]


HASHES = ["0000", "0000", "0001", "0003", "ffff", "fffe", "0101"]


@pytest.mark.parametrize(
    "threshold, num_bands, want",
    [(0, None, [0, 0, 1, 2, 3, 4, 5]), (1, None, [0, 0, 0, 0, 1, 1, 0]), (2, None, [0, 0, 0, 0, 1, 1, 0]), (1, 1, [0, 0, 1, 2, 3, 4, 5]), (2, 1, [0, 0, 1, 2, 3, 4, 5])],
)
def test_clusters(spark, threshold, num_bands, want):
    assert clustered(spark, HASHES, threshold, num_bands) == want


def test_null_codes_change_nothing(spark):
    assert clustered(spark, HASHES[:2] + [None] + HASHES[2:], 1, None) == [0, 0, 0, 0, 1, 1, 0]


def test_band_layout():
    assert [n for _, n in lsh.band_layout(256, 6)] == [37, 37, 37, 37, 36, 36, 36]
    assert lsh.band_layout(256, 6, -3) == [(1, 256)] and len(lsh.band_layout(8, 20)) == 8


def test_long_chain_and_hub(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001 + i) for i in range(150)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "src long, dst long")).collect()))
    assert set(got) == set(range(201)) | set(range(1000, 1151))
    assert {v for k, v in got.items() if k <= 200} == {0} and {v for k, v in got.items() if k >= 1000} == {1000}
    assert components.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def sequential(sizes, ratios):
    total, state, out = sum(sizes), dict.fromkeys(ratios, 0), []
    for n in sizes:
        best = max(ratios, key=lambda s: ratios[s] * total - state[s])
        state[best] += n
        out.append(best)
    return out, state


@pytest.mark.parametrize("sizes, want", [([1], (1, 0, 0)), ([1, 1], (2, 0, 0)), ([1] * 10, (7, 2, 1)), ([5, 3, 2], (8, 2, 0)), ([4] * 5, (12, 4, 4)), ([10, 1, 1, 1, 1], (10, 2, 2))])
def test_allocation_totals(spark, sizes, want):
    clusters = spark.createDataFrame([(i, n, "x") for i, n in enumerate(sizes)], "cluster_id long, n long, dominant_label string")
    got = clusters.join(allocate.allocate(clusters), "cluster_id").groupBy("split").agg(F.sum("n").alias("n")).collect()
    assert tuple({r.split: r.n for r in got}.get(s, 0) for s in allocate.RATIOS) == want


def test_runs_equal_the_sequential_rule():
    rng = np.random.default_rng(0)
    for _ in range(200):
        ratios = dict(zip("abcd", rng.dirichlet(np.ones(4))))
        sizes = sorted(rng.choice([1, 1, 1, 2, 3, 7, 30], rng.integers(1, 200)).tolist(), reverse=True)
        want, _ = sequential(sizes, ratios)
        r = np.array(list(ratios.values()))
        targets, state, got = r[None] * float(sum(sizes)), np.zeros((1, 4)), []
        for n in sorted(set(sizes), reverse=True):
            m = sizes.count(n)
            for p in range(m):
                got.append("abcd"[allocate.greedy_choice(targets, state, np.array([float(n)]), np.array([float(p)]))[1][0]])
            state, _ = allocate.greedy_choice(targets, state, np.array([float(n)]), np.array([float(m)]))
        assert got == want


def test_pcg64_order(spark):
    clusters = spark.createDataFrame([(i, 1 + i % 3, "ab"[i % 2]) for i in range(60)], "cluster_id long, n long, dominant_label string")
    got = dict(map(tuple, allocate.allocate(clusters, seed=7, generator="pcg64").collect()))
    rng, want = np.random.default_rng(7), {}
    for label in "ab":
        ids = [i for i in range(60) if "ab"[i % 2] == label]
        draw = {i: rng.random() for i in ids}
        order = sorted(ids, key=lambda i: (-(1 + i % 3), draw[i]))
        want |= dict(zip(order, sequential([1 + i % 3 for i in order], allocate.RATIOS)[0]))
    assert got == want


def test_dominant_label_and_errors(spark):
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (2, "z"), (2, "z"), (2, None), (None, "q")], "cluster_id long, label string")
    assert {r.cluster_id: (r.n, r.dominant_label) for r in allocate.cluster_summary(rows).collect()} == {1: (2, "a"), 2: (3, "z")}
    with pytest.raises(ValueError):
        allocate.check_ratios({"train": 0.7, "val": 0.2, "test": 0.2})
    with pytest.raises(ValueError):
        allocate.allocate(allocate.cluster_summary(spark.createDataFrame([(1, None)], "cluster_id long, label string")))


def test_leakage(spark):
    rows = spark.createDataFrame([(7, "train"), (7, "val"), (8, "test"), (8, "test"), (None, "val"), (9, None), (9, "val")], "cluster_id long, split string")
    assert [tuple(r) for r in allocate.leaking_clusters(rows).collect()] == [(7, 2)]
    with pytest.raises(AssertionError, match="7"):
        allocate.assert_no_leakage(rows)
    allocate.assert_no_leakage(rows.where("cluster_id <> 7"))


def test_empty_report(spark):
    empty = spark.createDataFrame([], "cluster_id long, label string, split string")
    assert report.cluster_stats(empty).first().asDict() == {"n_clusters": 0, "n_multiple": 0, "rows_multiple": 0, "largest": 0, "n_rows": 0, "percent": 0.0}
    assert [r.n for r in report.split_totals(empty).collect()] == [0, 0, 0] and report.label_split_pivot(empty).count() == 0
