"""Sums of numpy arrays over all rows of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Partial sums that meet in one task.
FAN_IN = 32


def summed(table: DataFrame, part: Callable[[pd.DataFrame], np.ndarray], shape: tuple[int, ...], fan_in: int = FAN_IN) -> np.ndarray:
    """Sum of ``part(batch)`` (of ``shape``) over the batches of ``table``, a scan of a written table.

    Each task adds up its own batches; the sums of the tasks meet ``fan_in`` at a time until one is left, and only that one
    reaches the driver.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(shape)
        for pdf in batches:
            if len(pdf):
                total += part(pdf)
        yield pd.DataFrame({"total": [total.tobytes()]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"g": pdf["g"].iloc[:1] // fan_in, "total": [sum(np.frombuffer(x) for x in pdf["total"]).tobytes()]})

    n = table.rdd.getNumPartitions()
    sums = table.mapInPandas(run, "total binary").select(F.floor(F.spark_partition_id() / fan_in).cast("long").alias("g"), "total")
    while n > 1:
        sums = sums.groupBy("g").applyInPandas(add, "g long, total binary")
        n = -(-n // fan_in)
    return sum((np.frombuffer(r.total).reshape(shape) for r in sums.select("total").collect()), np.zeros(shape))
