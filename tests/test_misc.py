import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpwork import pipeline
from kelpwork.functions.text import label_of, split_of
from kelpwork.operators import encode, images, metrics, sampling
from kelpwork.plans.order import numbered, ranks_by_hash
from kelpwork.sources.config import Settings
from kelpwork.sources import loader
from kelpwork.sources.sinks import HISTORY_SCHEMA, RUNS_SCHEMA, cache_key, read_index, read_results, write_index, write_results
from kelpwork.streaming.history import best_epochs_stream
from tests.test_scan import picture, png


def test_readings(spark):
    df = spark.createDataFrame([(" Training\t",), ("VAL",), ("holdout",), (None,), ("",), (" Test ",)], "s string")
    assert [r[0] for r in df.select(split_of(F.col("s"))).collect()] == ["train", "val", None, None, None, "test"]
    assert [r[0] for r in df.select(label_of(F.col("s"))).collect()] == ["training", "val", "holdout", None, "", "test"]


def test_positions(spark):
    df = spark.range(1000).select(F.md5(F.col("id").cast("string")).alias("h"), (F.col("id") % 3).alias("g")).repartition(7)
    order = [r.h for r in numbered(df, [F.col("h")], "pos").orderBy("pos").collect()]
    assert order == sorted(order) and len(order) == 1000
    got = ranks_by_hash(df, ["g"], "h", "rank").collect()
    for g in range(3):
        held = sorted((r.rank, r.h) for r in got if r.g == g)
        assert [x for x, _ in held] == list(range(len(held))) and [h for _, h in held] == sorted(h for _, h in held)
    assert numbered(df.where("false"), [F.col("h")], "pos").count() == 0


def test_random_split(spark):
    rows = spark.createDataFrame([(i, "abc"[min(2, i // 40)]) for i in range(101)] + [(999, None)], "id long, label string")
    got = sampling.random_split(rows, "id", "label", 0.2)
    assert got.where("split = 'test'").count() == 21 and got.count() == 101
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, sampling.random_split(rows.repartition(5), "id", "label", 0.2).collect()))
    with pytest.raises(ValueError):
        sampling.random_split(rows.where("id < 41"), "id", "label")
    assert sampling.sample_n(rows, "id", 500).count() == 102 and sampling.sample_n(rows, "id", 5).count() == 5
    with pytest.raises(ValueError):
        sampling.frame_checks(rows.where("false"), "label")


def test_batches(spark):
    rows = spark.range(10).toDF("id")
    sizes = lambda train: sorted(r["count"] for r in encode.batches(rows, "id", 4, train).groupBy("batch_id").count().collect())
    assert sizes(True) == [4, 4] and sizes(False) == [2, 4, 4]


def test_encode(spark):
    rows = spark.createDataFrame([("b",), ("a",)], "label string")
    assert [r.y for r in encode.encode_labels(rows, "label", ["b", "a"]).collect()] == [1, 0]
    with pytest.raises(Exception, match="unknown label"):
        encode.encode_labels(rows, "label", ["a"]).collect()


def test_schedule_and_summaries(spark):
    assert [round(r.factor, 9) for r in metrics.lr_schedule(spark, 40, 1.0).orderBy("epoch").limit(4).collect()] == [round(x, 9) for x in (1 / 3, 2 / 3, 1, 1)]
    assert [r.factor for r in metrics.lr_schedule(spark, 1, 1.0, 0).collect()] == [1.0]
    history = spark.createDataFrame([("m", 0, i, v) for i, v in enumerate([0.5, 0.7, 0.7, 0.6, None])], "model string, seed int, epoch int, val_acc double")
    assert [r.epoch for r in metrics.best_epochs(history, ["model", "seed"]).collect()] == [1]
    one = metrics.seed_summary(spark.createDataFrame([("f", "m", 0, 0.8, 0.9)], "family string, model string, seed int, best_val_acc double, test_acc double")).first()
    assert (one.test_acc_mean, one.test_acc_std, one.n_seeds) == (0.9, None, 1)


def test_stream_of_epochs(spark, tmp_path):
    data = "/root/testdata/sf0.001/run_history.parquet"
    batch = spark.read.parquet(data)
    batch.repartition(3).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    q = best_epochs_stream(stream, ["model", "seed"]).writeStream.outputMode("complete").format("memory").queryName("best").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("best").collect())) == sorted(map(tuple, metrics.best_epochs(batch, ["model", "seed"]).collect()))


def test_index_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([('a, "b".png', "1", 3, "train"), ("c", None, None, "val"), ("d", "NA", 4, "other")], "image_path string, label string, cluster_id long, split string")
    write_index(rows, str(tmp_path / "index"), ["train", "val", "test"])
    assert sorted(map(tuple, read_index(spark, str(tmp_path / "index")).collect())) == [('a, "b".png', "1", 3, "train"), ("c", None, None, "val")]


def test_cache_key(spark):
    scan = spark.createDataFrame([("a", 1, 2), ("b", 3, 4)], "image_path string, length long, modified long")
    assert cache_key(scan, {"t": 6}) == cache_key(scan.repartition(2), {"t": 6}) != cache_key(scan, {"t": 5})
    assert cache_key(scan.withColumn("length", F.col("length") + 1), {"t": 6}) != cache_key(scan, {"t": 6})


def test_pipeline(spark, tmp_path, capsys):
    for i in range(12):
        folder = tmp_path / "data" / "xy"[i % 2]
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{i}.png").write_bytes(png(picture(i % 5)))
    (tmp_path / "data" / "x" / "bad.png").write_bytes(b"no")
    config = tmp_path / "c.yaml"
    config.write_text(f"dataset: {{train_root: {tmp_path}/data, num_classes: 2, classes: [x, y]}}\noutput_dir: {tmp_path}/out\ndedup: {{hamming_threshold: 6, cache: cache}}\nsplit: {{ratios: {{train: 0.7, val: 0.15, test: 0.15}}, seed: 0, index_dir: splits}}\n")
    assert pipeline.run(spark, Settings.from_yaml(str(config)), str(config))
    meta = json.loads((tmp_path / "out/splits.meta.json").read_text())
    assert (meta["images_scanned"], meta["images_dropped"], meta["images_kept"], meta["leakage_ok"], meta["cache_hit"]) == (13, 1, 12, True, False)
    assert read_index(spark, f"{tmp_path}/out/splits").count() == 12
    assert pipeline.run(spark, Settings.from_yaml(str(config)), str(config))
    assert json.loads((tmp_path / "out/splits.meta.json").read_text())["cache_hit"] is True
    assert "leakage: none" in capsys.readouterr().out


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("- 1\n")
    with pytest.raises(ValueError):
        Settings.from_yaml(str(tmp_path / "c.yaml"))
    assert Settings({"output_dir": "/o"}).target("a/b") == "/o/a/b" and Settings({}).target("/x") == "/x" and Settings({}).target("s3a://b/x") == "s3a://b/x"


def test_loader(spark, tmp_path):
    """Index files and a tree of pictures to batches of tensors, for both kinds of transform; experiment frames and result tables."""
    for i in range(24):
        folder = tmp_path / "data" / "xy"[i % 2]
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{i}.png").write_bytes(png(picture(i % 7)))
    rows = [(f"{'xy'[i % 2]}/{i}.png", "xy"[i % 2], i, "train" if i < 14 else "val") for i in range(24)]
    write_index(spark.createDataFrame(rows, "image_path string, label string, cluster_id long, split string"), str(tmp_path / "index"), ["train", "val"])
    config = {"dataset": {"classes": ["y", "x"]}, "image": {"size": 16}, "loader": {"batch_size": 4}, "augmentation": {"rotation_degrees": 5, "color_jitter": {"hue": 0.1, "brightness": 0.3}}}
    out = loader.load(spark, config, str(tmp_path / "index"), str(tmp_path / "data"), ("train", "val"), seed=3)
    train, val = out["train"].collect(), out["val"].collect()
    assert len(train) == 12 and sorted(r.batch_id for r in train) == [0] * 4 + [1] * 4 + [2] * 4  # the partial batch is dropped
    assert sorted(r.batch_id for r in val) == [0] * 4 + [1] * 4 + [2] * 2
    assert all(len(r.tensor) == 3 * 16 * 16 and r.y == "xy".index(r.image_path[0]) for r in train + val)
    frames = loader.experiment_frames(spark, str(tmp_path / "data"), str(tmp_path / "data"), ["x", "y"], str(tmp_path / "frames"))
    assert {k: v.count() for k, v in frames.items()} == {"train": 19, "val": 5, "test": 24}
    with pytest.raises(ValueError):
        loader.experiment_frames(spark, str(tmp_path / "data"), str(tmp_path / "data"), ["z"])


def test_result_tables(spark, tmp_path):
    history = spark.createDataFrame([("m", 0, 1, 0.5, 0.6, None, 0.7, 1e-3)], HISTORY_SCHEMA)
    runs = spark.createDataFrame([("m", " f,1", 0, 0.7, 0.6), ("m", " f,1", 1, 0.9, None)], RUNS_SCHEMA)
    matrix = metrics.confusion_wide(metrics.confusion_matrix(spark.createDataFrame([(0, 1), (1, 1)], "y int, p int"), "y", "p", 2), 2)
    write_results(str(tmp_path), history, runs, matrix)
    read = lambda t: sorted(map(tuple, read_results(spark, str(tmp_path), t).collect()), key=str)
    assert read("history") == list(map(tuple, history.collect())) and read("runs") == sorted(map(tuple, runs.collect()), key=str)
    assert read("summary") == [(" f,1", "m", 0.6, None, 0.8, 2)] and read("confusion") == [(0, 0, 1), (1, 0, 1)]


def test_augmentation_of_a_configuration():
    a = images.Augmentation
    assert a.of({}) == a() and a.of({"augmentation": {"rand_augment": {}}}) == a(degrees=0, brightness=0, contrast=0, saturation=0, magnitude=9)
    full = {"random_resized_crop": {"scale": [0.5, 1.0]}, "color_jitter": {"hue": 0.2}, "rand_augment": {"num_ops": 3, "magnitude": 4}, "rotation_degrees": 7}
    assert a.of({"augmentation": full}) == a((0.5, 1.0), 7, 0, 0, 0, 0.2, 3, 4)


def test_random_operations():
    pixels = np.random.default_rng(0).integers(0, 256, (12, 12, 3)).astype(float)
    for sign in (-1.0, 1.0):
        operations = images._operations(12, 0.5, sign)
        assert len(operations) == 14
        for f in operations:
            out = f(pixels)
            assert out.shape == pixels.shape and np.isfinite(out).all()
    shifted = images._affine(pixels, right=3)
    assert (shifted[:, 3:] == pixels[:, :-3]).all() and (shifted[:, :3] == 0).all()  # nothing wraps around
    assert np.allclose(images._hue_turned(pixels, 1.0), pixels) and np.allclose(images._hue_turned(np.full((1, 1, 3), 9.0), 0.3), 9)
    red = np.zeros((1, 1, 3))
    red[..., 0] = 200
    assert np.allclose(images._hue_turned(red, 1 / 3), [[[0, 200, 0]]])


def test_single_rows_stay_in_the_first_part(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(20)] + [(99, "c")], "id long, label string")
    got = {r.id: r.split for r in sampling.random_split(rows, "id", "label", single="first").collect()}
    assert len(got) == 21 and got[99] == "train" and list(got.values()).count("test") == 4
