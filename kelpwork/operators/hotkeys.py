"""Results per key when a few keys hold most of the rows.

Counts are merged in two steps, so a hot key reaches its final task as one partial row per (label, split) and map task.
Exact per-key quantiles come from value histograms that are refined digit by digit: each round counts only values
that share the digits found so far, until every rank has one value left. No task ever holds the values of a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpwork.plans.shared import Stage
from kelpwork.plans.skew import HOT_ROWS

#: Binary digits of a value that one round resolves; a key has at most 2**DIGIT_BITS bins in a round.
DIGIT_BITS = 11
#: An open set of at most so many (key, prefix) rows is broadcast; a larger one is joined with salted keys.
BROADCAST_ROWS = 50_000


def _open_rows(values: DataFrame, open_bins: DataFrame, shift: int) -> DataFrame:
    """Rows of ``values`` whose prefix is still open for their key. One prefix may hold a third of all rows, hence salts,
    as many as the open rows need at HOT_ROWS a task."""
    wanted = open_bins.groupBy("key", "prefix").agg(F.max("n").alias("n_open"))
    tagged = values.where("value IS NOT NULL").withColumn("prefix", F.shiftright("value", shift))
    if wanted.count() <= BROADCAST_ROWS:
        return tagged.join(F.broadcast(wanted.drop("n_open")), ["key", "prefix"], "left_semi").select("key", "value", "n")
    most = wanted.agg(F.max("n_open")).first()[0]
    salts = -(-most // HOT_ROWS)
    salted = wanted.drop("n_open").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    tagged = tagged.withColumn("salt", F.pmod(F.xxhash64("value"), F.lit(salts)).cast("int"))  # values are distinct per key
    return tagged.join(salted.withColumn("salt", F.col("salt").cast("int")), ["key", "prefix", "salt"], "left_semi").select("key", "value", "n")


class KeyQuantiles:
    """Exact discrete quantiles (the smallest value whose rank is at least ``q * n``) of a LONG column per key.

    ``result`` is ``(key, q, value)``: rows with a null key do not count, a key without any value does not appear in it;
    ties and repeated rows count as often as they stand. ``rows`` is ``(key, n_rows)`` of every key, from the same
    histogram of the first round, in which null values have a bin of their own.
    """

    def __init__(self, df: DataFrame, key: str, value: str, probs: Sequence[float], stage: Stage):
        values = df.select(F.col(key).alias("key"), F.col(value).cast("long").alias("value")).where("key IS NOT NULL")
        values = stage.write(values.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n")), "values")
        low, high = values.agg(F.min("value"), F.max("value")).first()
        self.result = values.select("key", F.lit(0.0).alias("q"), "value").where("false")
        low, high = (0, 0) if low is None else (low, high)
        values = values.withColumn("value", F.col("value") - F.lit(low))
        shift = max(0, (high - low).bit_length() - DIGIT_BITS)
        bins = stage.write(_histogram(values, shift), "bins")
        self.rows = bins.groupBy("key").agg(F.sum("n").alias("n_rows"))
        # rank: how many of the values under the open prefix stand up to the wanted one
        by_key = Window.partitionBy("key")
        found = (
            bins.where("prefix IS NOT NULL")
            .withColumns({"up_to": F.sum("n").over(by_key.orderBy("prefix")), "total": F.sum("n").over(by_key)})
            .withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in probs])))
            .withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("total"))).cast("long"))
        )
        rows, level = values, 0
        while True:
            found = found.where("rank <= up_to AND rank > up_to - n").select("key", "q", "prefix", (F.col("rank") - F.col("up_to") + F.col("n")).alias("rank"), "lo", "hi", "n_values")
            found = stage.write(found, f"ranks{level}")
            self.result = self.result.unionByName(found.where("lo = hi").select("key", "q", (F.col("lo") + F.lit(low)).alias("value")))
            ranks = found.where("lo <> hi").select("key", "q", "prefix", "rank", F.col("n_values").alias("n"))
            if shift == 0 or ranks.isEmpty():
                break
            rows = stage.write(_open_rows(rows, ranks, shift), f"open{level}")
            last, shift, level = shift, max(0, shift - DIGIT_BITS), level + 1
            by_parent = Window.partitionBy("key", "parent").orderBy("prefix")
            parts = _histogram(rows, shift).withColumn("parent", F.shiftright("prefix", last - shift)).withColumn("up_to", F.sum("n").over(by_parent))
            found = parts.join(ranks.select("key", "q", F.col("prefix").alias("parent"), "rank"), ["key", "parent"])


def _histogram(values: DataFrame, shift: int) -> DataFrame:
    """Rows, distinct values and range of each bin of each key; the null bin holds the null values."""
    prefix = F.shiftright("value", shift).alias("prefix")
    return values.groupBy("key", prefix).agg(F.sum("n").alias("n"), F.count("value").alias("n_values"), F.min("value").alias("lo"), F.max("value").alias("hi"))


def key_counts(df: DataFrame, key: str, label: str, split: str) -> DataFrame:
    """Rows, distinct labels and rows per split of every non-null key: ``(key, n_rows, n_labels, n_train, n_val, n_test)``.

    ``label`` and ``split`` are columns already read; nulls count as rows only. The first step keeps at most one row per
    (key, label, split) and map task, so the second has no hot key.
    """
    cells = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key"), F.col(label).alias("l"), F.col(split).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    labels = cells.groupBy("key", "l").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col("s") == s, F.col("n"))).alias(s) for s in ("train", "val", "test")])
    return labels.groupBy("key").agg(
        F.sum("n").alias("n_rows"),
        F.count("l").alias("n_labels"),
        *[F.coalesce(F.sum(s), F.lit(0)).alias(f"n_{s}") for s in ("train", "val", "test")],
    )


def key_profile(df: DataFrame, key: str, label: str, split: str, value: str, probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """``key_counts`` with exact quantiles of ``value`` beside them (``q25``, ``q50`` ... null where a key has no value).

    An empty table gives an empty result. Extra columns of ``df`` are ignored, whatever their names.
    """
    stage = Stage(df.sparkSession, "hotkeys")
    narrow = df.select(F.col(key).alias("k"), F.col(label).alias("l0"), F.col(split).alias("s0"), F.col(value).alias("v0"))
    quantiles = KeyQuantiles(narrow, "k", "v0", probs, stage)
    wide = quantiles.result.groupBy("key").agg(*[F.max(F.when(F.col("q") == q, F.col("value"))).alias(f"q{round(q * 100)}") for q in probs])
    counted = key_counts(narrow, "k", "l0", "s0").drop("n_rows").join(quantiles.rows, "key")
    order = ["key", "n_rows", "n_labels", "n_train", "n_val", "n_test"]
    return counted.select(*order).join(wide, "key", "left")


def hot_keys(profile: DataFrame, share: float = 0.01) -> DataFrame:
    """Keys of a profile that hold at least ``share`` of all rows with a key. The total is one number."""
    total = profile.agg(F.sum("n_rows")).first()[0] or 0
    return profile.where(F.col("n_rows") >= F.lit(share) * F.lit(total))
