import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpwork.llm import overlap
from kelpwork.llm.overlap import SplitOverlap, file_key, segments

ROWS = "row_idx long, image_path string, cluster_id long, split string, source string, code string, train boolean, block int"


def brute(rows, prints, radius=6):
    from urllib.parse import unquote

    side = {**dict.fromkeys(["train", "training"], True), **dict.fromkeys(["val", "valid", "validation", "test", "testing"], False)}

    def key(p):
        if p is None:
            return None
        p = unquote(p).strip().lower().replace("\\", "/")
        while "//" in p:
            p = p.replace("//", "/")
        while p.startswith(("/", "./")):
            p = p[1:] if p[0] == "/" else p[2:]
        return p or None

    code = {i: int.from_bytes(c, "big") for i, c in prints if c is not None and len(c) == 32}
    known = {r[0]: r for r in rows if r[0] is not None and (r[3] or "").strip().lower() in side}
    out = set()
    for a in known.values():
        for b in known.values():
            if side[a[3].strip().lower()] and not side[b[3].strip().lower()]:
                same = (a[2] is not None and a[2] == b[2]) or (key(a[1]) is not None and key(a[1]) == key(b[1]))
                near = a[0] in code and b[0] in code and (code[a[0]] ^ code[b[0]]).bit_count() <= radius
                if same or near:
                    out.add((min(a[0], b[0]), max(a[0], b[0])))
    return out


def table(seed, n):
    r = random.Random(seed)
    base = [r.getrandbits(256) for _ in range(8)]
    names = ["x/a.png", "/x/a.png", "./x//A.png", "x\\a.png ", "x/%61.png", "x/b+c.png", "x/b%2Bc.png", "100%.png", "100%25.png", "", "/", None]
    rows, prints = [], []
    for i in range(n):
        path = r.choice(names) if r.random() < 0.2 else f"p{i}.png"
        rows.append((i, path, r.choice([None, 1, 1, 1, 2, r.randrange(100)]), r.choice(["train", " Training", "VAL", "test", "holdout", None, "testing\t"]), r.choice(["s", None]), "c", True, 3))
        code = r.choice(base)
        for _ in range(r.randrange(9)):
            code ^= 1 << r.randrange(256)
        prints.append((i, r.choice([None, b"short", code.to_bytes(32, "big"), code.to_bytes(32, "big")])))
    return rows + rows[:10], prints + prints[:10]


@pytest.mark.parametrize("block", [4096, 5])
def test_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(overlap, "BLOCK", block)
    monkeypatch.setattr("kelpwork.plans.skew.BLOCK", block)
    monkeypatch.setattr("kelpwork.plans.skew.HOT_ROWS", 10 * block)
    monkeypatch.setattr("kelpwork.plans.skew.MOST_ROWS", 10 * block)
    rows, prints = table(block, 260)
    found = SplitOverlap(spark.createDataFrame(rows, ROWS), spark.createDataFrame(prints, "row_idx long, fp binary"))
    got = [tuple(r) for r in found.pairs().collect()]
    want = brute(rows, prints)
    assert len(got) == len(set(got)) and set(got) == want
    report = found.report().collect()
    assert sum(r.n_pairs for r in report) == len(want)
    evals = {i for p in want for i in p} & {r[0] for r in rows if (r[3] or "").strip().lower() not in ("train", "training")}
    assert sum(r.n_overlapping for r in report) == len(evals)
    per_row = Counter(i for p in want for i in p if i in evals)
    assert {r.row_idx: r.n_links for r in found.links().collect()} == per_row


def test_segments_that_many_codes_share(spark):
    """10,000 codes share six of the seven segments with each other: they meet in blocks, and the pairs are right."""
    r = random.Random(2)
    rows, prints = [], []
    for i in range(10_000):
        rows.append((i, f"p{i}", None, "train" if i % 10 else "test", "s", "c", True, 1))
        prints.append((i, bytes(28) + r.getrandbits(32).to_bytes(4, "big")))
    found = SplitOverlap(spark.createDataFrame(rows, ROWS), spark.createDataFrame(prints, "row_idx long, fp binary"))
    code = np.array([int.from_bytes(c[28:], "big") for _, c in prints], np.uint32)
    train, test = np.arange(10_000) % 10 > 0, np.arange(10_000) % 10 == 0
    near = np.bitwise_count(code[train][:, None] ^ code[test][None]) <= 6
    assert found.near.count() == near.sum() == found.report().first().n_pairs


def test_empty(spark):
    rows, prints = spark.createDataFrame([], ROWS), spark.createDataFrame([], "row_idx long, fp binary")
    assert SplitOverlap(rows, prints).pairs().count() == 0 and SplitOverlap(rows, prints).report().count() == 0


def test_file_key(spark):
    df = spark.createDataFrame([(" ./X\\\\y%20z.PNG ",), ("x/y z.png",), ("/",), (None,), ("a%zz",)], "p string")
    assert [r[0] for r in df.select(file_key(F.col("p"))).collect()] == ["x/y z.png", "x/y z.png", None, None, "a%zz"]
    assert segments(32, 7) == [(1, 5), (6, 5), (11, 5), (16, 5), (21, 4), (25, 4), (29, 4)]
