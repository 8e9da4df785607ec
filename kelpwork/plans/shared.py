"""Cutting lineage with tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, on a local master only, a folder of this session."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="kelpwork-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as Hadoop has it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = file_system(spark, path)
    return system.exists(where)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file on any of Hadoop's file systems; folders above it are made."""
    system, where = file_system(spark, path)
    out = system.create(where, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def folders_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path``, sorted. Raises if there is no such folder."""
    system, where = file_system(spark, path)
    if not system.exists(where) or not system.getFileStatus(where).isDirectory():
        raise FileNotFoundError(path)
    return sorted(x.getPath().getName() for x in system.listStatus(where) if x.isDirectory())


def _remove(spark: SparkSession, path: str) -> None:
    system, where = file_system(spark, path)
    system.delete(where, True)


_open: dict[str, Stage] = {}


@contextmanager
def released() -> Iterator[None]:
    """Removes, at its end, the tables of all operators that ran inside; what is wanted of them must be written by then.

    Without it they stay until the session ends, since a result that was not written yet still reads them.
    """
    before = set(_open)
    try:
        yield
    finally:
        for root in [r for r in _open if r not in before]:
            _open[root].close()


class Stage:
    """Tables written by one operator run; ``drop`` removes those that no later plan reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        _open[self.root] = self

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` once and returns a scan of it: later plans restart from files, whatever executors are lost."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def counted(self, df: DataFrame, name: str, of: Column | None = None) -> tuple[DataFrame, int]:
        """The same, and the number of rows, or another aggregate, which the writing job finds."""
        seen = Observation()
        table = self.write(df.observe(seen, (F.count(F.lit(1)) if of is None else of).alias("n")), name)
        return table, seen.get["n"]

    def drop(self, name: str) -> None:
        _remove(self.spark, f"{self.root}/{name}")

    def close(self) -> None:
        _open.pop(self.root, None)
        try:
            if self.spark.sparkContext._jsc is not None:
                _remove(self.spark, self.root)
                return
        except Exception:  # the session is gone
            pass
        if self.root.startswith(("/", "file:/")):
            shutil.rmtree("/" + self.root.removeprefix("file:").lstrip("/"), ignore_errors=True)


@atexit.register
def _close_all() -> None:
    for stage in list(_open.values()):
        stage.close()
