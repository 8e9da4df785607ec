"""Evaluation figures and experiment summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def argmax(scores: Column) -> Column:
    """Place from 0 of the first largest element."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def accuracy(rows: DataFrame, y: str, pred: str) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(y) == F.col(pred)).cast("double")).alias("accuracy"))


def weighted_loss(rows: DataFrame, loss: str, weight: str, *keys: str) -> DataFrame:
    """Mean of batch losses weighted by batch size; batches with a null loss do not count."""
    used = F.col(loss).isNotNull()
    total = F.sum(F.when(used, F.col(weight)))
    return rows.groupBy(*keys).agg((F.sum(F.col(loss) * F.col(weight)) / total).alias("loss"))


def smoothed_cross_entropy(logits: Column, y: Column, epsilon: float = 0.1) -> Column:
    """(1 - e) * -log p_y + e / C * sum of -log p_k, with a stable log-sum-exp."""
    top = F.array_max(logits)
    lse = top + F.log(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x.cast("double") - top.cast("double"))))
    own = lse - F.get(logits, y)
    mean = lse - F.aggregate(logits, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(logits)
    return F.lit(1 - epsilon) * own + F.lit(epsilon) * mean


def confusion_matrix(rows: DataFrame, y: str, pred: str, n_classes: int) -> DataFrame:
    """``(y, pred, n)`` for every pair of classes, zeros kept; pairs with another class or null do not count."""
    counts = rows.groupBy(F.col(y).cast("int").alias("y"), F.col(pred).cast("int").alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    spine = rows.sparkSession.range(n_classes * n_classes).select(F.floor(F.col("id") / n_classes).cast("int").alias("y"), (F.col("id") % n_classes).cast("int").alias("pred"))
    return spine.join(counts, ["y", "pred"], "left").na.fill(0, ["n"])


def confusion_wide(matrix: DataFrame, n_classes: int) -> DataFrame:
    """The same with one row per true class and one column ``p<k>`` per predicted one."""
    return matrix.groupBy("y").agg(*[F.sum(F.when(F.col("pred") == k, F.col("n")).otherwise(0)).alias(f"p{k}") for k in range(n_classes)])


def lr_schedule(spark: SparkSession, epochs: int, base_lr: float, warmup: int = 3) -> DataFrame:
    """``(epoch, factor, lr)``: linear warm-up, then half a cosine."""
    e = F.col("epoch")
    span = max(1, epochs - warmup)
    cosine = 0.5 * (1 + F.cos(F.lit(3.141592653589793) * F.least(F.lit(1.0), (e - warmup) / F.lit(float(span)))))
    factor = F.when(e < warmup, (e + 1) / F.lit(float(max(1, warmup)))).otherwise(cosine)
    return spark.range(epochs).select(F.col("id").cast("int").alias("epoch")).withColumn("factor", factor).withColumn("lr", F.col("factor") * base_lr)


def best_epochs(history: DataFrame, keys: list[str], epoch: str = "epoch", value: str = "val_acc") -> DataFrame:
    """Per key the earliest epoch of the largest value: ``(*keys, epoch, value)``. Null values never win."""
    best = F.max(F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), (-F.col(epoch)).alias("e"))))
    return history.groupBy(*keys).agg(best.alias("b")).where("b IS NOT NULL").select(*keys, (-F.col("b.e")).alias(epoch), F.col("b.v").alias(value))


def seed_summary(runs: DataFrame) -> DataFrame:
    """Per family and model: mean and sample deviation of test_acc, mean best_val_acc, distinct seeds."""
    return runs.groupBy("family", "model").agg(F.avg("test_acc").alias("test_acc_mean"), F.stddev_samp("test_acc").alias("test_acc_std"), F.avg("best_val_acc").alias("val_acc_mean"), F.count_distinct("seed").alias("n_seeds"))


def model_seed_grid(models: DataFrame, model: str, seeds: list[int]) -> DataFrame:
    """Every model with every seed, and a tag; the seeds are a literal list."""
    names = models.select(F.col(model).alias("model")).where("model IS NOT NULL").distinct()
    return names.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds]))).withColumn("tag", F.concat_ws("_seed", "model", F.col("seed").cast("string")))


def decay_groups(params: DataFrame, name: str = "name", ndim: str = "ndim") -> DataFrame:
    """Adds ``decay``: false for vectors and for names that end in ``.bias``."""
    return params.withColumn("decay", ~((F.col(ndim) == 1) | F.col(name).endswith(".bias")))
