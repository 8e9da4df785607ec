"""Listing and reading image trees."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpwork.operators.scan import extension, file_name, images_only, in_scan_order, labelled, prefix_label
from kelpwork.plans.shared import folders_in

_LISTED = "path STRING, modified LONG, length LONG"


def _local(root: str) -> str:
    return "/" + root.removeprefix("file:").lstrip("/") if root.startswith("file:") else root


def mounted(root: str) -> bool:
    """Whether ``root`` is a path on a file system that driver and executors mount; else it is read by Spark's sources."""
    return "://" not in root or root.startswith("file:")


def listing(spark: SparkSession, root: str, depth: int) -> DataFrame:
    """``(path, modified, length)`` of the files exactly ``depth`` folders below ``root``, hidden names included.

    On a mounted file system folders are listed by tasks: the driver only reads the names in ``root`` itself. On any other
    Spark's file source lists, which does not see hidden names. Raises if ``root`` does not exist.
    """
    if not mounted(root):
        folders_in(spark, root)
        return binary_images(spark, root, depth).select("path", F.unix_timestamp("modificationTime").alias("modified"), "length")
    base = _local(root)
    if not os.path.isdir(base):
        raise FileNotFoundError(root)

    def files(folder: str) -> list[tuple[str, int, int]]:
        with os.scandir(folder) as found:
            return [(e.path, int(e.stat().st_mtime), e.stat().st_size) for e in found if e.is_file()]

    if depth == 0:
        return spark.createDataFrame(files(base), _LISTED)
    folders = [(os.path.join(base, d),) for d in folders_in(spark, root)]
    if not folders:
        return spark.createDataFrame([], _LISTED)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame([f for folder in pdf["folder"] for f in files(folder)], columns=["path", "modified", "length"])

    return spark.createDataFrame(folders, "folder string").repartition(min(len(folders), 64)).mapInPandas(run, _LISTED)


def scan_dataset(spark: SparkSession, root: str, classes: Sequence[str] | None = None) -> tuple[DataFrame, dict]:
    """Images of ``root/<class>/<file>``: ``(row_idx, image_path, label, path, modified, length)`` and what was found.

    Without ``classes`` (None or empty) every subfolder is a class, sorted. With them only their folders are read; missing
    and extra ones are named in the second result. Not recursive; the extension decides, in any case.
    """
    folders = folders_in(spark, root)
    wanted = list(classes) if classes else folders
    files = labelled(images_only(listing(spark, root, 1)))
    rows = in_scan_order(files.where(F.col("label").isin(*wanted)) if wanted else files.where("false"), wanted)
    info = {
        "root": root,
        "subdirs": folders,
        "missing_classes": [c for c in wanted if c not in folders] if classes else [],
        "extra_folders": [d for d in folders if d not in wanted] if classes else [],
    }
    return rows.select("row_idx", "image_path", "label", "path", "modified", "length"), info


def scan_folder(spark: SparkSession, root: str, classes: Sequence[str]) -> DataFrame:
    """``(image_path, label)`` with absolute paths: by folder if ``root`` has any, else by the beginnings of file names."""
    if folders_in(spark, root):
        files = labelled(images_only(listing(spark, root, 1))).where(F.col("label").isin(*classes))
    else:
        files = images_only(listing(spark, root, 0)).withColumn("name", file_name(F.col("path")))
        files = prefix_label(files, "name", classes)
    return files.select(F.col("path").alias("image_path"), "label")


def with_content(rows: DataFrame, path: str = "path", root: str = "") -> DataFrame:
    """Adds the bytes of each file, null where it cannot be read; files are opened by the tasks. Where ``root`` is not mounted
    they come from Spark's file source instead, by a join on the path."""
    if not mounted(root):
        held = binary_images(rows.sparkSession, root).select(F.col("path").alias(path), "content")
        return rows.join(held, path, "left").select(*rows.columns, "content")

    def run(batches):
        for pdf in batches:
            out = []
            for p in pdf[path]:
                try:
                    with open(_local(p), "rb") as f:
                        out.append(f.read())
                except OSError:
                    out.append(None)
            yield pdf.assign(content=out)

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{types}, content binary")


def binary_images(spark: SparkSession, root: str, depth: int = 1) -> DataFrame:
    """The files ``depth`` folders below ``root`` through Spark's own file source, for object stores: names that begin with ``_``
    or ``.`` are not seen."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    parts = len(_local(root).rstrip("/").split("/")) + 1 + depth
    if mounted(root):
        files = files.withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    return files.where((F.size(F.split("path", "/")) == parts) & (extension(file_name(F.col("path"))) != ""))
