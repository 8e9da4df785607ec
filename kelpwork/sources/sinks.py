"""Index files, run metadata, and the cluster table that is kept between runs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpwork.operators.metrics import seed_summary
from kelpwork.plans.shared import exists, write_text

INDEX_SCHEMA = "image_path STRING, label STRING, cluster_id LONG"


#: Text is written as it stands, outer blanks included.
_CSV = {"header": True, "emptyValue": "", "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_csv(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").options(**_CSV).csv(folder)


def write_index(rows: DataFrame, folder: str, splits: Sequence[str]) -> None:
    """CSV index per split, ``folder/split=<s>/``; rows of other splits are not written."""
    rows.where(F.col("split").isin(*splits)).select("image_path", "label", "cluster_id", "split").write.mode("overwrite").options(**_CSV).partitionBy("split").csv(folder)


def read_index(spark: SparkSession, folder: str, split: str | None = None) -> DataFrame:
    """The index with its types, so labels such as ``1`` or ``NA`` stay text; one split is one folder."""
    rows = spark.read.schema(INDEX_SCHEMA + ", split STRING").option("header", True).option("escape", '"').csv(folder)
    return rows if split is None else rows.where(F.col("split") == split)


HISTORY_SCHEMA = "model STRING, seed INT, epoch INT, train_loss DOUBLE, train_acc DOUBLE, val_loss DOUBLE, val_acc DOUBLE, lr DOUBLE"
RUNS_SCHEMA = "model STRING, family STRING, seed INT, best_val_acc DOUBLE, test_acc DOUBLE"
SUMMARY_SCHEMA = "family STRING, model STRING, test_acc_mean DOUBLE, test_acc_std DOUBLE, val_acc_mean DOUBLE, n_seeds LONG"


def write_results(folder: str, history: DataFrame | None = None, runs: DataFrame | None = None, confusion: DataFrame | None = None) -> None:
    """CSV tables of experiments below ``folder``: ``history`` and ``runs`` as they are, ``summary`` of the runs, and
    ``confusion``, a row per true class and a column per predicted one."""
    if history is not None:
        write_csv(history, f"{folder}/history")
    if runs is not None:
        write_csv(runs, f"{folder}/runs")
        write_csv(seed_summary(runs), f"{folder}/summary")
    if confusion is not None:
        write_csv(confusion, f"{folder}/confusion")


def read_results(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One of the tables, with its types."""
    reader = spark.read.option("header", True).option("escape", '"')
    schemas = {"history": HISTORY_SCHEMA, "runs": RUNS_SCHEMA, "summary": SUMMARY_SCHEMA}
    if table in schemas:
        return reader.schema(schemas[table]).csv(f"{folder}/{table}")
    held = reader.csv(f"{folder}/{table}")
    return held.select(*[F.col(c).cast("long").alias(c) for c in held.columns])


def write_metadata(spark: SparkSession, path: str, meta: dict) -> None:
    write_text(spark, path, json.dumps(meta, indent=2, ensure_ascii=False))


def cache_key(scan: DataFrame, settings: dict) -> str:
    """Digest of the scanned files (path, length, time) and the settings; independent of row order and partitioning."""
    one = F.xxhash64("image_path", "length", "modified").cast("decimal(38,0)")
    other = F.xxhash64("modified", "image_path", "length", F.lit(1)).cast("decimal(38,0)")
    state = scan.agg(F.count(F.lit(1)), F.sum(one), F.sum(other)).first()
    return hashlib.sha256(json.dumps([str(x) for x in state] + [settings], sort_keys=True).encode()).hexdigest()[:32]


def cached(spark: SparkSession, folder: str, key: str, make, force: bool = False) -> tuple[DataFrame, bool]:
    """The table kept under ``key``, made and written first if it is not there or ``force`` is set; and whether it was."""
    path = f"{folder}/{key}"
    hit = not force and exists(spark, f"{path}/_SUCCESS")
    if not hit:
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), hit
