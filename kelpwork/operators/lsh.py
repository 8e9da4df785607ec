"""Near-duplicate join of binary codes within a Hamming radius, by bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpwork.operators.fingerprint import BITS, bit_string, distance_of, words64
from kelpwork.plans.skew import blocked_join

THRESHOLD = 6


def band_layout(bits: int, threshold: int, num_bands: int | None = None) -> list[tuple[int, int]]:
    """(start from 1, length) of each band. 0 or None bands means one more than the threshold, which loses no pair;
    the number is held within 1 and ``bits``; the first bands are longer by one where it does not divide."""
    n = max(1, min(num_bands or threshold + 1, bits))
    base, longer = divmod(bits, n)
    starts, at = [], 1
    for i in range(n):
        starts.append((at, base + (i < longer)))
        at += starts[-1][1]
    return starts


def representatives(prints: DataFrame, row: str = "row_idx", code: str = "fp") -> DataFrame:
    """``(rep, fp, n)``: the first row of each distinct code, and how many rows have it. Null codes are dropped."""
    return prints.where(F.col(code).isNotNull()).groupBy(F.col(code).alias("fp")).agg(F.min(row).alias("rep"), F.count(F.lit(1)).alias("n"))


def _cut(bits: int, threshold: int, num_bands: int | None) -> Column:
    """The bands of the column ``bits``, a text of that many 0 and 1 (more may follow)."""
    return F.array(*[F.struct(F.lit(i).alias("band"), F.substring("bits", s, n).alias("key")) for i, (s, n) in enumerate(band_layout(bits, threshold, num_bands))])


def bands(reps: DataFrame, threshold: int = THRESHOLD, num_bands: int | None = None, bits: int = BITS) -> DataFrame:
    """``(rep, band, key)``; the bit string is made once per code. ``bits`` are the first bits of the bytes of a code."""
    return reps.withColumn("bits", bit_string(F.col("fp"), -(-bits // 8))).select("rep", F.explode(_cut(bits, threshold, num_bands)).alias("b")).select("rep", "b.band", "b.key")


def candidates(banded: DataFrame) -> DataFrame:
    """``(src, dst)`` with src < dst: pairs that share a band, once."""
    left = banded.select("band", "key", F.col("rep").alias("src"))
    right = banded.select("band", "key", F.col("rep").alias("dst"))
    return blocked_join(left, right, ["band", "key"], "src", "dst").where("src < dst").select("src", "dst").distinct()


def near_edges(reps: DataFrame, threshold: int = THRESHOLD, num_bands: int | None = None, bits: int = BITS) -> DataFrame:
    """``(src, dst, distance)`` of representatives at most ``threshold`` bits apart.

    The words travel with the bands, so a pair is verified where it meets and only edges are made distinct: a bucket's
    pairs are never written. Keys travel as hashes of the band. A bucket that many codes share is joined in blocks.
    """
    n_bytes = -(-bits // 8)
    words = reps.select("rep", F.array(*words64(F.col("fp"), n_bytes)).alias("w"), bit_string(F.col("fp"), n_bytes).alias("bits"))
    keyed = words.select("rep", "w", F.explode(_cut(bits, threshold, num_bands)).alias("b")).select("rep", "w", F.xxhash64("b.band", "b.key").alias("bucket"))
    left = keyed.select("bucket", F.col("rep").alias("src"), F.col("w").alias("wa"))
    right = keyed.select("bucket", F.col("rep").alias("dst"), F.col("w").alias("wb"))
    met = blocked_join(left, right, ["bucket"], "src", "dst").where("src < dst")
    met = met.withColumn("distance", distance_of([F.col("wa")[i] for i in range(-(-n_bytes // 8))], [F.col("wb")[i] for i in range(-(-n_bytes // 8))]))
    return met.where(F.col("distance") <= threshold).select("src", "dst", "distance").distinct()
