"""From index files to batches of tensors, and from folders to the frames of an experiment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpwork.operators import encode, images, sampling
from kelpwork.sources.images import scan_folder, with_content
from kelpwork.sources.sinks import read_index, write_csv


def with_root(rows: DataFrame, root: str, image_path: str = "image_path") -> DataFrame:
    """Adds ``path``: ``root`` and the relative path of the index. A null path stays null."""
    return rows.withColumn("path", F.concat(F.lit(root.rstrip("/") + "/"), F.col(image_path)))


def index_batches(spark: SparkSession, index_dir: str, root: str, split: str, classes: Sequence[str], batch_size: int, seed: int = 0, strict: bool = True) -> DataFrame:
    """``(image_path, label, cluster_id, split, path, y, batch_id)`` of one split of an index.

    Training rows are shuffled by hash and their last partial batch is dropped; rows of other splits keep the order of
    their paths. Rows that are equal in path, label and cluster are interchangeable.
    """
    rows = encode.encode_labels(with_root(read_index(spark, index_dir, split), root), "label", classes, strict)
    key = F.concat_ws("\x1f", "image_path", "label", "cluster_id")
    order = [F.col("image_path"), F.col("label"), F.col("cluster_id")]
    return encode.batches_in(rows, [encode.hash_order(seed, key), *order] if split == "train" else order, batch_size, split == "train")


def load(spark: SparkSession, config: dict, index_dir: str, root: str, splits: Sequence[str] = ("train", "val", "test"), seed: int = 0, epoch: int = 0) -> dict[str, DataFrame]:
    """Per split the batches of an index as tensors: ``(image_path, y, batch_id, tensor)``.

    ``config`` has ``dataset.classes``, ``image.size``, ``loader.batch_size`` and, for training, ``augmentation``. The tensor
    of an unreadable picture is null. An unknown label raises when its row is read.
    """
    size = int(config.get("image", {}).get("size", 224))
    out = {}
    for split in splits:
        rows = index_batches(spark, index_dir, root, split, config["dataset"]["classes"], int(config["loader"]["batch_size"]), seed + epoch)
        held = with_content(rows.select("image_path", "path").distinct())
        if split == "train":
            tensors = images.train_tensors(held, "image_path", seed, epoch, size=size, how=images.Augmentation.of(config))
        else:
            tensors = images.eval_tensors(held, "image_path", size=size)
        out[split] = rows.select("image_path", "y", "batch_id").join(tensors, "image_path")
    return out


def experiment_frames(spark: SparkSession, train_root: str, test_root: str, classes: Sequence[str], out: str | None = None, val_share: float = 0.2, seed: int = 0) -> dict[str, DataFrame]:
    """``train``, ``val`` and ``test`` as ``(image_path, label)`` with absolute paths: the training folder split at random by
    label, the test folder as it is. Written as CSV below ``out``. Raises if one of them is empty."""
    both = sampling.random_split(scan_folder(spark, train_root, classes), "image_path", "label", val_share, seed, ("train", "val"))
    frames = {s: both.where(F.col("split") == s).select("image_path", "label") for s in ("train", "val")}
    frames["test"] = scan_folder(spark, test_root, classes)
    for name, frame in frames.items():
        sampling.frame_checks(frame, "label")
        if out:
            write_csv(frame, f"{out}/{name}")
    return frames
