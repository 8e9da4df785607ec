"""Turning a listing of paths into (image_path, label) rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpwork.plans.order import numbered

#: Extensions of image files.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".ppm", ".tif", ".tiff", ".webp")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(name: Column) -> Column:
    """Lower-case suffix of a file name; empty if there is none or the name is nothing else (``.png``)."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?s)^(.+)\.[^.]+$", "$1")


def images_only(files: DataFrame, path: str = "path") -> DataFrame:
    """Files with an image extension. Null paths are dropped."""
    return files.where(extension(file_name(F.col(path))).isin(*IMAGE_EXTENSIONS))


def labelled(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds ``label`` (the folder of the file) and ``image_path`` (``label/name``); files outside any folder are dropped."""
    parts = F.split(F.col(path), "/")
    return files.where(F.size(parts) >= 2).withColumns({"label": F.element_at(parts, -2), "image_path": F.concat_ws("/", F.element_at(parts, -2), F.element_at(parts, -1))})


def class_differences(found: DataFrame, label: str, expected: Sequence[str]) -> DataFrame:
    """``(kind, label, pos)``: expected classes that were not found, in expected order, and found ones not expected, sorted."""
    spark = found.sparkSession
    want = spark.createDataFrame([(c, i) for i, c in enumerate(expected)], "label string, at long")
    have = found.select(F.col(label).alias("label")).where("label IS NOT NULL").distinct()
    missing = want.join(have, "label", "left_anti").select(F.lit("missing").alias("kind"), "label", (F.row_number().over(Window.orderBy("at")) - 1).cast("long").alias("pos"))  # at most the given classes
    extra = numbered(have.join(want, "label", "left_anti").select(F.lit("extra").alias("kind"), "label"), [F.col("label")], "pos")
    return missing.unionByName(extra)


def in_scan_order(files: DataFrame, classes: Sequence[str], label: str = "label", path: str = "image_path") -> DataFrame:
    """Adds ``row_idx``: rows by position of their class in ``classes``, then by path; rows of other classes are dropped.

    Positions are dense from 0. The rows are range-partitioned by (class, path), numbered within their partition and
    shifted by the rows of the partitions before it, so no task holds a whole class.
    """
    spark = files.sparkSession
    order = spark.createDataFrame([(c, i) for i, c in enumerate(classes)], "label string, class_pos int")
    kept = files.join(F.broadcast(order).withColumnRenamed("label", label), label)
    return numbered(kept, [F.col("class_pos"), F.col(path)], "row_idx").drop("class_pos")


def prefix_label(files: DataFrame, name: str, classes: Sequence[str]) -> DataFrame:
    """Label of files in one flat folder: the class equal to the lower-case stem, else the longest class that begins it
    (of equal ones the first). Files without a class are dropped."""
    low = F.lower(stem(F.col(name)))
    ranked = sorted(enumerate(classes), key=lambda c: (-len(c[1]), c[0]))
    label = F.coalesce(*[F.when(low == c.lower(), F.lit(c)) for c in classes], *[F.when(low.startswith(c.lower()), F.lit(c)) for _, c in ranked], F.lit(None).cast("string"))
    return files.withColumn("label", label).where("label IS NOT NULL")
