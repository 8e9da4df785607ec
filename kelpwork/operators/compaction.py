"""Consolidating very many tiny index files into few well-sized ones, without losing or repeating a record.

Planning is SQL over the frozen manifest: files in order of ``file_id``, running sum of bytes, one group per
target-sized interval of that sum. The running sum is taken in two steps (range partitions of files, then within one),
so no task sees the whole manifest, however sparse the ids are. Texts are parsed where they are read; what moves are
records: once to the first record of each path, once to the file of their group.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from kelpwork.plans.shared import Stage
from kelpwork.sources.index_csv import index_records

#: Bytes of index text of one consolidated file.
TARGET_BYTES = 128 << 20

_PLAN = """
WITH blocks AS (
  SELECT block, sum(bytes) OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM (SELECT block, sum(n_bytes) AS bytes FROM {manifest} GROUP BY block)
), running AS (
  SELECT file_id, n_bytes, coalesce(before, 0) + sum(n_bytes) OVER (
           PARTITION BY m.block ORDER BY file_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS up_to
  FROM {manifest} m JOIN blocks b ON m.block = b.block
)
SELECT file_id, n_bytes, CAST(up_to - n_bytes AS BIGINT) AS starts_at, CAST((up_to - n_bytes) DIV {target} AS BIGINT) AS group_id
FROM running
"""


def freeze_manifest(files: DataFrame, stage: Stage) -> DataFrame:
    """``(file_id, n_bytes, digest, copies, block)``, one row per file, written so that files which arrive later take no part.

    A file listed several times counts once; of differing contents the one with the largest ``digest`` holds. A null
    ``n_bytes`` is replaced by the length of the content, 0 if that is null too. Rows without ``file_id`` are no files.
    ``block`` numbers range partitions of ``file_id`` in their order.
    """
    sized = F.coalesce(F.col("n_bytes"), F.octet_length("content").cast("long"), F.lit(0))
    one = files.where("file_id IS NOT NULL").select(F.col("file_id").cast("long").alias("file_id"), sized.cast("long").alias("n_bytes"), _digest().alias("digest"))
    held = one.groupBy("file_id").agg(F.max("n_bytes").alias("n_bytes"), F.max("digest").alias("digest"), F.count(F.lit(1)).alias("copies"))
    held = stage.write(held, "listed").repartitionByRange("file_id")  # bounds are sampled, so the rows are written first
    return stage.write(held.withColumn("block", F.spark_partition_id()), "manifest")


def _digest():
    """Null for a null content, which any other copy of the file goes before."""
    return F.when(F.col("content").isNotNull(), F.xxhash64("content"))


def plan_groups(manifest: DataFrame, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """``(file_id, n_bytes, starts_at, group_id)``: the group of a file is the target-sized interval in which it starts.

    A file larger than the target is alone with the small ones that start before it in the same interval; files are
    never cut. Ties cannot occur, since ``file_id`` is the key. The only window without partitions is over blocks.
    """
    return manifest.sparkSession.sql(_PLAN.format(manifest="{manifest}", target=int(target_bytes)), manifest=manifest)


class Consolidation:
    """Plan, records and outcome of one consolidation. An empty table, and columns of any other name, are allowed."""

    def __init__(self, files: DataFrame, target_bytes: int = TARGET_BYTES):
        self.stage = Stage(files.sparkSession, "compaction")
        self.manifest = freeze_manifest(files, self.stage)
        self.groups = self.stage.write(plan_groups(self.manifest, target_bytes), "groups")
        texts = files.where("file_id IS NOT NULL").select(F.col("file_id").cast("long").alias("file_id"), "content", _digest().alias("digest"))
        parsed = self.stage.write(index_records(texts, "file_id", "content", "digest"), "parsed")
        # files that were listed several times give their records once
        several = self.manifest.where("copies > 1").select("file_id", F.col("digest").alias("holds"))
        once = parsed.join(several, "file_id").where("digest <=> holds").drop("holds", "digest").distinct()
        self.records = parsed.join(several, "file_id", "left_anti").drop("digest").unionByName(once)

    def kept(self) -> DataFrame:
        """``(image_path, file_id, rec_no, label, cluster_id, n)``: of each path its first record in (file_id, rec_no) order,
        and how many it has.

        The minimum is merged map-side, so a path recorded in very many files reaches its task as few rows.
        """
        first = F.min(F.struct("file_id", "rec_no", "label", "cluster_id")).alias("r")
        return self.records.groupBy("image_path").agg(first, F.count(F.lit(1)).alias("n")).select("image_path", "r.*", "n")

    @cached_property
    def written(self) -> DataFrame:
        """The consolidated files, written at first use."""
        return self.rewrite(f"{self.stage.root}/consolidated")

    def rewrite(self, out: str) -> DataFrame:
        """Writes one Parquet file per group and reads it back; raises if the outcome does not reconcile: every record read
        is kept or repeated, every path stands once, and labels and clusters have the checksum they had when written.

        ``cluster_id`` is LONG, null where the text is no whole number; an empty label is null.
        """
        rows = self.kept().join(self.groups.select("file_id", "group_id"), "file_id").select(
            "group_id", "file_id", "rec_no", "image_path", F.nullif("label", F.lit("")).alias("label"), F.expr("try_cast(trim(cluster_id) AS BIGINT)").alias("cluster_id"), "n"
        )
        mark = F.coalesce(F.sum(F.xxhash64("image_path", "label", "cluster_id").cast("decimal(38,0)")), F.lit(0)).alias("mark")
        seen = Observation()
        n_groups = (self.groups.agg(F.max("group_id")).first()[0] or 0) + 1
        placed = rows.repartitionById(n_groups, F.col("group_id").cast("int")).sortWithinPartitions("file_id", "rec_no")
        # observed by the writing tasks, which count once each, also where lost executors make Spark repeat a stage before them
        placed = placed.observe(seen, F.count(F.lit(1)).alias("kept"), F.coalesce(F.sum("n"), F.lit(0)).alias("records"), mark).drop("n")
        placed.write.mode("overwrite").parquet(out)
        back = rows.sparkSession.read.schema(placed.schema).parquet(out)
        stands = back.agg(F.count(F.lit(1)).alias("kept"), F.count_distinct(F.coalesce("image_path", F.lit(""))).alias("paths"), mark).first()
        wanted, n_read = seen.get, self.records.count()
        if (stands.kept, stands.paths, stands.mark, n_read) != (wanted["kept"], wanted["kept"], wanted["mark"], wanted["records"]):
            raise ValueError(f"{n_read} records read, {wanted} on the way, {stands} written")
        return back

    def repeated(self) -> DataFrame:
        """``(file_id, rec_no)`` of the records that the consolidated files left out, since their path stands earlier."""
        return self.records.select("file_id", "rec_no").join(self.written.select("file_id", "rec_no"), ["file_id", "rec_no"], "left_anti")

    def report(self) -> DataFrame:
        """Per group: files, bytes, records read, kept and left out; read = kept + left out."""
        files = self.groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_bytes").alias("n_bytes"))
        read = self.records.groupBy("file_id").agg(F.count(F.lit(1)).alias("n")).join(self.groups, "file_id").groupBy("group_id").agg(F.sum("n").alias("n_records"))
        kept = self.written.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_kept"))
        both = files.join(read, "group_id", "left").join(kept, "group_id", "left").na.fill(0, ["n_records", "n_kept"])
        return both.withColumn("n_repeated", F.col("n_records") - F.col("n_kept"))
