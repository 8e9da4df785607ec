import numpy as np
import pytest

from kelpwork.llm.cube import ProportionSample, flight

TARGETS = "plan_id long, split string, label string, target_share double, min_rows long, sample_size long"
ROWS = "row_idx long, split string, label string, sample string, pi double, wanted long"


def test_flight_keeps_sums_and_expectations():
    rng = np.random.default_rng(0)
    pi, group = rng.random(60), rng.integers(0, 4, 60)
    total = np.zeros(60)
    for seed in range(800):
        out = flight(pi, group, np.arange(60) + 1000, seed)
        for g in range(4):
            assert abs(out[group == g].sum() - pi[group == g].sum()) < 1e-6
            assert ((out[group == g] > 0) & (out[group == g] < 1)).sum() <= 1
        total += out
    assert np.abs(total / 800 - pi).max() < 0.08
    assert flight(np.array([]), np.array([]), np.array([], dtype=int), 1).size == 0


@pytest.mark.parametrize("bucket_rows", [200_000, 100, 7])
def test_sample(spark, bucket_rows):
    rows = [(i, " Train", "AB c"[i % 2], "x", 0.0, 1) for i in range(900)] + [(2000 + i, "train", "rare", "x", 0.0, 1) for i in range(5)]
    rows += rows[:50] + [(5000, None, "A", "x", 0.0, 1), (5001, "train", None, "x", 0.0, 1), (None, "train", "A", "x", 0.0, 1)]
    targets = [(1, "train", "a", 0.55, 3, 201), (1, "train", "b", 0.40, None, 201), (1, "train", "rare", 0.01, 8, 201), (1, "train", "none", 0.04, 0, 201), (2, "val", "a", 1.0, 0, 10), (3, "train", "rare", None, 2, None)]
    drawn = ProportionSample(spark.createDataFrame(rows, ROWS), spark.createDataFrame(targets, TARGETS), bucket_rows=bucket_rows)
    sample = [tuple(r) for r in drawn.sample().collect()]
    assert len(sample) == len(set(sample))
    assert {(i, lab) for _, _, lab, i in sample} <= {(i, lab.strip().lower()) for i, _, lab, *_ in rows if lab is not None}
    report = {(r.plan_id, r.split, r.label): r for r in drawn.report().collect()}
    assert len(report) == len(targets)
    for key, r in report.items():
        assert abs(r.sampled - min(r.wanted, r.available)) < 1, key
        assert r.sampled >= min(r.min_rows or 0, r.available)
    assert {k for k, r in report.items() if r.short} == {(1, "train", "rare"), (1, "train", "none"), (2, "val", "a")}
    assert sum(1 for s in sample if s[0] == 1) in (195, 196)  # 110.55 + 80.4 + 5
    again = ProportionSample(spark.createDataFrame(rows, ROWS).repartition(3), spark.createDataFrame(targets, TARGETS), bucket_rows=bucket_rows)
    assert sorted(map(tuple, again.sample().collect())) == sorted(sample)


def test_empty(spark):
    empty = spark.createDataFrame([], ROWS)
    one = spark.createDataFrame([(1, "train", "a", 0.5, 1, 4)], TARGETS)
    assert ProportionSample(empty, one).sample().count() == 0
    assert [r.short for r in ProportionSample(empty, one).report().collect()] == [True]
    assert ProportionSample(empty, spark.createDataFrame([], TARGETS)).report().count() == 0
