import random

import numpy as np
import pandas as pd
import pytest

from kelpwork.llm import leaks
from kelpwork.llm.characters import codes_of, hashes, mixed
from kelpwork.llm.leaks import leaked_items, word_ids, words

DATA = "/root/testdata/sf0.001"


def test_nine_known_words(spark):
    item = [f"wort{i}" for i in range(40)]
    # every window has 9 known words at most: all that the comparison asks for
    altered = " ".join(w if i % 3 else f"fremd{i}" for i, w in enumerate(item))
    docs = spark.createDataFrame([(1, altered), (2, " ".join(item)), (3, " ".join(item[::3]))], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, passage string")
    got = {r.doc_id: r for r in leaked_items(docs, items).collect()}
    assert set(got) == {1, 2} and (got[1].exact, got[1].common) == (False, 9) and got[2].exact


def test_passages_of_one_id_beyond_a_block(spark, monkeypatch):
    monkeypatch.setattr(leaks, "ITEM_BLOCK", 2)
    texts = [" ".join(f"wort{k}x{i}" for i in range(13)) for k in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(7, t) for t in texts], "item_id long, passage string")
    assert sorted((r.doc_id, r.item_id) for r in leaked_items(docs, items).where("exact").collect()) == [(0, 7), (1, 7), (2, 7)]


def test_word_ids(monkeypatch):
    r = random.Random(3)
    pool = ["the", "THE", "Über", "e\u0301", "ﬁ", "①", "x_y", "½", "_", " ", ".", "\u200b", "日本", "\n", "1", "İ"]
    for size in (1 << 20, 20):
        monkeypatch.setattr("kelpwork.llm.characters.CHUNK", size)
        for _ in range(200):
            text = "".join(r.choices(pool, k=r.randint(0, 30))) + " end"
            one = lambda w: mixed(hashes(codes_of(w), np.array([0]), np.array([len(w)])))[0]
            assert word_ids(text).tolist() == [one(w) for w in words(text)] or size == 20
    assert word_ids("a b\n" * 20).tolist() == word_ids("A, b; " * 20).tolist()


@pytest.mark.parametrize("chunk", [78, 78 * 1_300])
def test_long_texts_are_cut_with_an_overlap(spark, monkeypatch, chunk):
    monkeypatch.setattr(leaks, "CHUNK_WORDS", chunk)
    r = random.Random(5)
    item = [f"wort{i}" for i in range(60)]
    fill = lambda n: [f"x{r.randrange(500)}" for _ in range(n)]
    docs = [(k, " ".join(fill(k * 7) + item[k % 40 : k % 40 + 13] + fill(300))) for k in range(40)]
    docs += [(100 + k, " ".join(fill(k) + item[:12] + fill(200) + item[20:32])) for k in range(20)]
    got = leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, passage string")).where("exact")
    assert sorted(x.doc_id for x in got.collect()) == list(range(40))


def test_items_longer_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(leaks, "ITEM_WORDS", 100)
    item = [f"wort{i}" for i in range(700)]
    docs = spark.createDataFrame([(k, " ".join(["kopf", *item[k : k + 13], "fuss"])) for k in range(0, 680, 11)], "doc_id long, text string")
    got = leaked_items(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, passage string")).where("exact").collect()
    assert sorted(x.doc_id for x in got) == list(range(0, 680, 11))


def paraphrase(r, passage, pool, rate, kind):
    out = list(passage)
    if kind == "reorder":
        for a in range(len(out) - 1):
            if r.random() < rate / 2:
                out[a], out[a + 1] = out[a + 1], out[a]
    if kind in ("replace", "both"):
        out = [r.choice(pool) if r.random() < rate * (0.5 if kind == "both" else 1) else x for x in out]
    if kind in ("drop", "both"):
        out = [x for x in out if r.random() >= rate * (0.5 if kind == "both" else 1)]
    return out


def test_recall_of_planted_paraphrases(spark):
    """10 to 40 percent of the words replaced, dropped or reordered, in the middle of other text: nine of ten are found."""
    r = random.Random(1)
    docs = pd.read_parquet(f"{DATA}/documents.parquet")[["doc_id", "text"]].dropna()
    items = pd.read_parquet(f"{DATA}/eval_items.parquet").dropna(subset=["passage"])[["item_id", "passage"]]
    pool = [w for t in docs["text"] for w in t.split()]
    held = [(i, p.split()) for i, p in zip(items["item_id"], items["passage"]) if len(p.split()) >= 40]
    planted, rows = set(), []
    for k in range(240):
        i, passage = r.choice(held)
        host = pool[(a := r.randrange(len(pool) - 200)) : a + 150]
        rows.append((10**6 + k, " ".join(host[:70] + paraphrase(r, passage, pool, (0.1, 0.2, 0.3, 0.4)[k % 4], ("replace", "drop", "reorder", "both")[k // 4 % 4]) + host[70:])))
        planted.add((10**6 + k, i))
    docs = spark.createDataFrame(pd.concat([docs, pd.DataFrame(rows, columns=["doc_id", "text"])]))
    found = {(x.doc_id, x.item_id) for x in leaked_items(docs, spark.createDataFrame(items)).collect()}
    assert len(planted & found) >= 0.9 * len(planted)
