"""Label codes, positional access and batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpwork.functions.text import hash_order
from kelpwork.plans.order import numbered


def class_codes(classes: Sequence[str]) -> dict[str, int]:
    """Code of each class: its place in sorted order."""
    return {c: i for i, c in enumerate(sorted(classes))}


def encode_labels(rows: DataFrame, label: str, classes: Sequence[str], strict: bool = True) -> DataFrame:
    """Adds ``y``. With ``strict`` an unknown or null label raises when the row is read, else its code is null."""
    table = F.create_map(*[F.lit(x) for pair in class_codes(classes).items() for x in pair])
    code = F.try_element_at(table, F.col(label))
    if strict:
        code = F.when(code.isNull(), F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(F.col(label), F.lit("null")))).cast("int")).otherwise(code)
    return rows.withColumn("y", code)


def row_at(rows: DataFrame, row_idx: int, column: str = "row_idx") -> DataFrame:
    return rows.where(F.col(column) == row_idx)


def batches_in(rows: DataFrame, order: Sequence[Column], size: int, drop_last: bool) -> DataFrame:
    """Adds ``batch_id`` by position in ``order``; with ``drop_last`` a last partial batch is left out."""
    out = numbered(rows, order, "__pos")
    if drop_last:
        out = out.where(F.col("__pos") < out.count() // size * size)
    return out.withColumn("batch_id", F.floor(F.col("__pos") / size).cast("long")).drop("__pos")


def batches(rows: DataFrame, row_id: str, size: int, train: bool, seed: int = 0) -> DataFrame:
    """Adds ``batch_id``. For training rows are shuffled by hash and the last partial batch is dropped; else they keep the
    order of ``row_id``, which must be unique, and all batches stay."""
    return batches_in(rows, [hash_order(seed, F.col(row_id)), F.col(row_id)] if train else [F.col(row_id)], size, train)
