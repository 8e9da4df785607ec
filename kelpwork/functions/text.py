"""Reading of free-form labels and split names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The accepted spellings of each split.
SPLITS = {"train": ("train", "training"), "val": ("val", "valid", "validation"), "test": ("test", "testing")}


def stripped(c: Column) -> Column:
    """Without surrounding white space of any script; null stays null."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def label_of(c: Column) -> Column:
    return F.lower(stripped(c))


def split_of(c: Column) -> Column:
    """train, val or test; null for any other word and for null."""
    word = label_of(c)
    read = F.lit(None).cast("string")
    for name, words in SPLITS.items():
        read = F.when(word.isin(*words), name).otherwise(read)
    return read


def hash_order(seed: int, *cols: Column) -> Column:
    """A reproducible random order that SQL engines share: md5 of seed and key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]))
