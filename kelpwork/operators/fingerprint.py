"""256-bit fingerprints: of texts in SQL, of images by a perceptual hash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpwork.operators.decoders import NoDecoder

HASH_SIZE = 16
BITS = HASH_SIZE * HASH_SIZE


def _bits_of_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buckets = batch.column(1)
        lengths = np.where(buckets.is_valid(), np.diff(buckets.offsets.to_numpy()), 0)
        row = np.repeat(np.arange(len(batch)), lengths)
        flat = buckets.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        bits = []
        for at in range(0, len(batch), 4_096):  # the counts of a slice are 8 MB
            here = (row >= at) & (row < at + 4_096)
            n = min(4_096, len(batch) - at)
            counts = np.bincount((row[here] - at) * BITS + flat[here], minlength=n * BITS).reshape(n, BITS)
            above = counts > np.median(counts, axis=1, keepdims=True)
            bits += [x.tobytes().decode("ascii") for x in (above + ord("0")).astype(np.uint8)]
        held = [x if ok else None for x, ok in zip(bits, buckets.is_valid().to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.string())], ["row_idx", "bits"])


def text_fingerprint(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(row_idx, bits)``: bit i is set if bucket i of 256 holds more of the text's words than the median bucket.

    A word is a run of other characters than blank, tab, LF, FF or CR in the lower-case text; its bucket is the first
    byte of its md5. Null texts have null bits; a text without words has no bit set; repeated rows stay. Nothing is
    shuffled: words are cut and hashed in the JVM, and only bucket numbers go to Python, to be counted.
    """
    words = F.filter(F.split(F.lower(F.col(text)), "[ \t\n\f\r]+"), lambda w: F.length(w) > 0)
    buckets = F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 2), 16, 10).cast("short"))
    rows = docs.select(F.col(doc_id).alias("row_idx"), buckets.alias("buckets"))
    return rows.mapInArrow(_bits_of_buckets, f"row_idx {rows.schema['row_idx'].dataType.simpleString()}, bits string")


def words64(code: Column, n_bytes: int = BITS // 8) -> list[Column]:
    """A binary code as 64-bit words."""
    return [F.conv(F.hex(F.substring(code, 8 * i + 1, 8)), 16, -10).cast("long") for i in range(-(-n_bytes // 8))]


def distance_of(a: list[Column], b: list[Column]) -> Column:
    """Number of differing bits of two codes given as words."""
    return sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b)), F.lit(0))


def bit_string(code: Column, n_bytes: int = BITS // 8) -> Column:
    """The bits of the first ``n_bytes`` of a code as text."""
    part = lambda at, n: F.lpad(F.conv(F.hex(F.substring(code, at + 1, n)), 16, 2), 8 * n, "0")
    return F.concat(*[part(at, min(8, n_bytes - at)) for at in range(0, n_bytes, 8)])


def _area_resize(gray: np.ndarray, size: int) -> np.ndarray:
    """Mean over the area of each target cell."""

    def weights(n: int) -> np.ndarray:
        edges = np.linspace(0, n, size + 1)
        at = np.arange(n)
        over = np.minimum(edges[1:, None], at[None] + 1) - np.maximum(edges[:-1, None], at[None])
        return np.clip(over, 0, None) / (n / size)

    return weights(gray.shape[0]) @ gray @ weights(gray.shape[1]).T


def _dct(n: int) -> np.ndarray:
    k = np.arange(n)
    return np.cos(np.pi * k[:, None] * (2 * k[None] + 1) / (2 * n)) * 2


def perceptual_hash(gray: np.ndarray, hash_size: int = HASH_SIZE) -> bytes:
    """Low frequencies of the DCT of the image at four times ``hash_size``, each above the median or not, packed.

    They are rounded first, so that no bit hangs on the order of summation where frequencies are zero.
    """
    side = 4 * hash_size
    d = _dct(side)
    low = (d @ _area_resize(gray.astype(float), side) @ d.T)[:hash_size, :hash_size].round(6)
    return np.packbits(low > np.median(low)).tobytes()


def image_fingerprint(images: DataFrame, key: str, decode, content: str = "content", hash_size: int = HASH_SIZE, num_partitions: int | None = None) -> DataFrame:
    """``(key, fp)`` of the images whose bytes stand in ``content``; fp is null where ``decode`` fails, unless
    for want of a decoder (``NoDecoder``), which ends the run.

    ``decode`` takes bytes and returns a gray array. ``num_partitions`` sets the parallelism of the hashing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            codes = []
            for data in pdf["content"]:
                try:
                    codes.append(perceptual_hash(decode(data), hash_size))
                except NoDecoder:
                    raise
                except Exception:  # an unreadable image is counted, not raised
                    codes.append(None)
            yield pd.DataFrame({"key": pdf["key"], "fp": codes})

    rows = images.select(F.col(key).alias("key"), F.col(content).alias("content"))
    if num_partitions:
        rows = rows.repartition(num_partitions)
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInPandas(run, f"key {kind}, fp binary").withColumnRenamed("key", key)


def n_dropped(prints: DataFrame) -> DataFrame:
    """``(scanned, dropped, kept)``."""
    return prints.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(F.col("fp").isNull()).alias("dropped"), F.count("fp").alias("kept"))
