"""Best epochs from an epoch log that is still being written."""

from __future__ import annotations

from pyspark.sql import DataFrame

from kelpwork.operators.metrics import best_epochs


def best_epochs_stream(history: DataFrame, keys: list[str]) -> DataFrame:
    """``best_epochs`` of a streaming log: the same aggregate, kept per run in the state store.

    Repeated and late rows change nothing but the maximum, so no watermark is needed; use output mode ``complete`` or
    ``update``. The state has one row per run.
    """
    return best_epochs(history, keys)
