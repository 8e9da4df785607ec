"""Queries over the test tables for the operators of the core, and their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpwork.functions.text import label_of, split_of
from kelpwork.operators import allocate, components, encode, fingerprint, images, lsh, metrics, report, sampling, scan
from kelpwork.operators.compaction import TARGET_BYTES, Consolidation
from kelpwork.operators.hotkeys import hot_keys, key_profile
from kelpwork.plans.shared import Stage
from kelpwork.sources import loader
from kelpwork.sources.sinks import read_results, write_index, write_results

#: Classes as the test tables name them, and beginnings of part names.
CLASSES = ("fist", "flat", "fistup", "claw", "flatb", "hook", "claw5", "fork", "hooked", "ring", "cup", "bent", "bentv", "pinch", "pinchx", "horn", "wave", "spread", "thumb", "thumbin", "crook", "stack", "curl", "cross", "twist", "tap", "lift", "snap", "point", "rest", "salute")
FLAT_CLASSES = ("al", "a", "f", "fi", "pr", "pro", "s", "st", "ste")


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _profile(spark: SparkSession, sf: str) -> DataFrame:
    rows = _table(spark, sf, "split_rows").select(
        "cluster_id", label_of(F.col("label")).alias("label"), split_of(F.col("split")).alias("split"),
        F.expr("timestampdiff(MICROSECOND, assigned_at, loaded_at)").alias("delay"),
    )
    return key_profile(rows, "cluster_id", "label", "split", "delay").withColumnRenamed("key", "cluster_id")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return hot_keys(_profile(spark, sf)).select("cluster_id")


def p2_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Per cluster: rows, labels, rows per split, and quartiles of the microseconds from assignment to loading."""
    return _profile(spark, sf)


def _consolidation(spark: SparkSession, sf: str) -> Consolidation:
    return Consolidation(_table(spark, sf, "index_files"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _consolidation(spark, sf).repeated()


def p4_groups(spark: SparkSession, sf: str) -> DataFrame:
    return _consolidation(spark, sf).groups


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    return _consolidation(spark, sf).report()


def p4_records(spark: SparkSession, sf: str) -> DataFrame:
    """The consolidated files, read back."""
    return _consolidation(spark, sf).written



def _rows(spark: SparkSession, sf: str) -> DataFrame:
    """The split table, one row per row_idx, with label and split as they are read."""
    rows = _table(spark, sf, "split_rows").dropDuplicates(["row_idx"])
    return rows.select("row_idx", "image_path", label_of(F.col("label")).alias("label"), "cluster_id", split_of(F.col("split")).alias("split"))


def _prints(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "fingerprints")


def scan_ext_filter(spark: SparkSession, sf: str) -> DataFrame:
    return scan.images_only(_table(spark, sf, "split_rows").select("row_idx", "image_path"), "image_path").distinct()


def scan_label_path(spark: SparkSession, sf: str) -> DataFrame:
    files = _table(spark, sf, "index_files").select("file_id", "file_path")
    return scan.labelled(files, "file_path").select("file_id", "label", "image_path").distinct()


def class_missing_extra(spark: SparkSession, sf: str) -> DataFrame:
    return scan.class_differences(_rows(spark, sf), "label", CLASSES)


def scan_row_order(spark: SparkSession, sf: str) -> DataFrame:
    files = _table(spark, sf, "split_rows").select(label_of(F.col("label")).alias("label"), "image_path").where("image_path IS NOT NULL").distinct()
    return scan.in_scan_order(files, CLASSES)


def flat_prefix_label(spark: SparkSession, sf: str) -> DataFrame:
    return scan.prefix_label(_table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", FLAT_CLASSES)


def fingerprint_256(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprint.text_fingerprint(_table(spark, sf, "documents"), "doc_id", "text")


def dropped_counts(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprint.n_dropped(_prints(spark, sf))


def exact_dup_reps(spark: SparkSession, sf: str) -> DataFrame:
    return lsh.representatives(_prints(spark, sf)).select("rep", "n")


def lsh_bands(spark: SparkSession, sf: str) -> DataFrame:
    return lsh.bands(lsh.representatives(_prints(spark, sf)))


def lsh_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return lsh.candidates(lsh.bands(lsh.representatives(_prints(spark, sf))))


def near_dup_edges(spark: SparkSession, sf: str) -> DataFrame:
    return lsh.near_edges(lsh.representatives(_prints(spark, sf)))


def lsh_underbanded(spark: SparkSession, sf: str) -> DataFrame:
    return lsh.near_edges(lsh.representatives(_prints(spark, sf)), num_bands=3)


def dup_components(spark: SparkSession, sf: str) -> DataFrame:
    return components.components(near_dup_edges(spark, sf))


def cluster_ids(spark: SparkSession, sf: str) -> DataFrame:
    reps = lsh.representatives(_prints(spark, sf))
    return components.cluster_ids(_prints(spark, sf).dropDuplicates(["row_idx"]), reps, lsh.near_edges(reps))


def cluster_size_label(spark: SparkSession, sf: str) -> DataFrame:
    return allocate.cluster_summary(_rows(spark, sf))


def _allocated(spark: SparkSession, sf: str, **how) -> DataFrame:
    """Clusters are sized by all their rows; those without any label are a class of their own, named by the empty text."""
    clusters = allocate.cluster_summary(_rows(spark, sf))
    return allocate.allocate(clusters.na.fill("", ["dominant_label"]), **how)


def split_stratified(spark: SparkSession, sf: str) -> DataFrame:
    return allocate.with_split(_rows(spark, sf), _allocated(spark, sf)).select("row_idx", "cluster_id", "split")


def split_global(spark: SparkSession, sf: str) -> DataFrame:
    return _allocated(spark, sf, stratify=False)


def split_pcg64(spark: SparkSession, sf: str) -> DataFrame:
    return _allocated(spark, sf, generator="pcg64")


def leakage_offenders(spark: SparkSession, sf: str) -> DataFrame:
    return allocate.leaking_clusters(_rows(spark, sf))


def cluster_stats(spark: SparkSession, sf: str) -> DataFrame:
    return report.cluster_stats(_rows(spark, sf))


def split_totals(spark: SparkSession, sf: str) -> DataFrame:
    return report.split_totals(_rows(spark, sf))


def label_split_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return report.label_split_pivot(_rows(spark, sf))


def random_split_exact(spark: SparkSession, sf: str) -> DataFrame:
    """All rows: those without a label are a class of their own, and classes of one row stay in train."""
    rows = _rows(spark, sf).select("row_idx", "label", F.coalesce("label", F.lit("")).alias("class"))
    return sampling.random_split(rows, "row_idx", "class", single="first").select("row_idx", "label", "split")


def sample_512(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.sample_n(_rows(spark, sf).select("row_idx", "label"), "row_idx", 512)


def per_class_20(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.per_class_k(_rows(spark, sf).select("row_idx", "label"), "row_idx", "label", 20)


def frame_checks(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.frame_checks(_rows(spark, sf), "label")


def label_encode(spark: SparkSession, sf: str) -> DataFrame:
    return encode.encode_labels(_rows(spark, sf), "label", CLASSES, strict=False).select("row_idx", "label", "y")


def batches_train(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, sf).where("split = 'train'").select("row_idx")
    return encode.batches(rows, "row_idx", 128, train=True)


def batches_eval(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, sf).where("split = 'val'").select("row_idx")
    return encode.batches(rows, "row_idx", 128, train=False)


def channel_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """The 64 numbers of a vector as four channels of 16."""
    rows = _table(spark, sf, "embeddings")
    out = images.normalized(F.col("embedding"), [0.485, 0.456, 0.406, 0.5], [0.229, 0.224, 0.225, 0.25])
    return rows.select("vec_id", F.round(F.aggregate(out, F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.get(out, F.lit(17)), 9).alias("x17"))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    logits = F.slice("embedding", 1, 10)
    rows = _table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("y"), logits.alias("logits"))
    return rows.withColumn("pred", metrics.argmax(F.col("logits")))


def argmax_prediction(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("vec_id", "y", "pred")


def argmax_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.accuracy(_scored(spark, sf), "y", "pred")


def smoothed_ce(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("vec_id", F.round(metrics.smoothed_cross_entropy(F.col("logits"), F.col("y")), 6).alias("loss"))


def weighted_loss(spark: SparkSession, sf: str) -> DataFrame:
    rows = _table(spark, sf, "run_history").distinct()
    return metrics.weighted_loss(rows.withColumn("bs", F.col("epoch") + 1), "train_loss", "bs", "model").withColumn("loss", F.round("loss", 9))


def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion_matrix(_scored(spark, sf), "y", "pred", 10)


def confusion_wide(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion_wide(metrics.confusion_matrix(_scored(spark, sf), "y", "pred", 10), 10)


def lr_schedule(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.lr_schedule(spark, 40, 5e-4).select("epoch", F.round("factor", 12).alias("factor"), F.round("lr", 12).alias("lr"))


def best_epoch(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.best_epochs(_table(spark, sf, "run_history"), ["model", "seed"])


def seed_summary(spark: SparkSession, sf: str) -> DataFrame:
    runs = _table(spark, sf, "runs").withColumn("family", label_of(F.col("family"))).distinct()
    out = metrics.seed_summary(runs)
    return out.select("family", "model", *[F.round(c, 9).alias(c) for c in ("test_acc_mean", "test_acc_std", "val_acc_mean")], "n_seeds")


def model_seed_grid(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.model_seed_grid(_table(spark, sf, "runs"), "model", [0, 1, 2])


def decay_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Part types as parameter names, sizes as dimensions."""
    params = _table(spark, sf, "part").select("p_partkey", F.concat(F.col("p_type"), F.when(F.col("p_size") % 2 == 0, ".bias").otherwise(".weight")).alias("name"), (F.col("p_size") % 3).alias("ndim"))
    return metrics.decay_groups(params)


def phash_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as gray pictures of 8 x 8, through the perceptual hash of images."""
    rows = _table(spark, sf, "embeddings").select("vec_id", images.gray_bytes(F.col("embedding")).alias("content"))
    return fingerprint.image_fingerprint(rows, "vec_id", images.decode_raw_square).select("vec_id", F.hex("fp").alias("fp"))


def image_batches(spark: SparkSession, sf: str) -> DataFrame:
    """The same pictures through the evaluation transform at its full size, in batches; of each tensor size and sum."""
    rows = _table(spark, sf, "embeddings").select("vec_id", "label", images.gray_bytes(F.col("embedding")).alias("content"))
    tensors = images.eval_tensors(rows, "vec_id", images.decode_raw_square)
    sums = tensors.select("vec_id", F.size("tensor").alias("n"), F.round(F.aggregate("tensor", F.lit(0.0), lambda a, x: a + x), 3).alias("total"))
    return encode.batches(sums, "vec_id", 64, train=False)


def index_batches(spark: SparkSession, sf: str) -> DataFrame:
    """The validation part of the split table, written as an index, read back and batched with paths and label codes."""
    folder = f"{Stage(spark, 'index').root}/splits"
    write_index(_rows(spark, sf), folder, ["train", "val", "test"])
    return loader.index_batches(spark, folder, "/data/images", "val", CLASSES, 128, strict=False).select("path", "cluster_id", "y", "batch_id")


def results_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The tables of experiments, written and read back: runs beside the summary of their model."""
    folder = f"{Stage(spark, 'results').root}/tables"
    runs = _table(spark, sf, "runs").distinct().withColumn("family", label_of(F.col("family"))).distinct()
    write_results(folder, runs=runs)
    read = read_results(spark, folder, "runs").join(read_results(spark, folder, "summary"), ["family", "model"])
    return read.select("family", "model", "seed", "best_val_acc", "test_acc", F.round("test_acc_mean", 9).alias("test_acc_mean"), "n_seeds")


QUERIES = {f.__name__: f for f in (p2_found, p2_profile, p4_found, p4_groups, p4_report, p4_records)}
QUERIES |= {
    f.__name__: f
    for f in (
        scan_ext_filter, scan_label_path, class_missing_extra, scan_row_order, flat_prefix_label, fingerprint_256, dropped_counts, exact_dup_reps, lsh_bands, lsh_candidates,
        near_dup_edges, lsh_underbanded, dup_components, cluster_ids, cluster_size_label, split_stratified, split_global, split_pcg64, leakage_offenders, cluster_stats, split_totals,
        label_split_pivot, random_split_exact, sample_512, per_class_20, frame_checks, label_encode, batches_train, batches_eval, channel_normalize, argmax_prediction, argmax_accuracy,
        smoothed_ce, weighted_loss, confusion_matrix, confusion_wide, lr_schedule, best_epoch, seed_summary, model_seed_grid, decay_groups, phash_vectors, image_batches,
        index_batches, results_summary,
    )
}

SPLIT_SQL = """CASE WHEN lower(trim({0}, E' \\t\\r\\n')) IN ('train', 'training') THEN 'train'
  WHEN lower(trim({0}, E' \\t\\r\\n')) IN ('val', 'valid', 'validation') THEN 'val'
  WHEN lower(trim({0}, E' \\t\\r\\n')) IN ('test', 'testing') THEN 'test' END"""
LABEL_SQL = "lower(trim({0}, E' \\t\\r\\n'))"

_FILES = f"""
f AS (SELECT file_id, max(coalesce(n_bytes, strlen(content), 0)) AS n_bytes, max(content) AS content FROM index_files WHERE file_id IS NOT NULL GROUP BY file_id),
g AS (SELECT file_id, n_bytes, content, CAST(sum(n_bytes) OVER (ORDER BY file_id ROWS UNBOUNDED PRECEDING) - n_bytes AS BIGINT) AS starts_at FROM f)"""
_RECORDS = _FILES + f""",
lines AS (
  SELECT file_id, starts_at // {TARGET_BYTES} AS group_id, pos, line, regexp_extract_all(',' || line, ',("([^"]|"")*"|[^,"][^,]*|)', 1) AS raw
  FROM (SELECT file_id, starts_at, unnest(l) AS line, generate_subscripts(l, 1) AS pos
        FROM (SELECT file_id, starts_at, list_filter(regexp_split_to_array(regexp_replace(content, '^\\x{{FEFF}}+', ''), '[\\r\\n]+'), lambda x: x <> '') AS l FROM g))
), cut AS (
  SELECT file_id, group_id, pos, [CASE WHEN x[1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END for x in raw] AS v
  FROM lines WHERE len(raw) = 3 AND length(array_to_string(raw, ',')) = length(line)
), head AS (SELECT file_id, v AS names FROM cut WHERE pos = 1 AND list_sort(v) = ['cluster_id', 'image_path', 'label']),
rec AS (
  SELECT c.file_id, group_id, row_number() OVER (PARTITION BY c.file_id ORDER BY pos) AS rec_no,
    v[list_position(coalesce(names, ['image_path', 'label', 'cluster_id']), 'image_path')] AS image_path,
    v[list_position(coalesce(names, ['image_path', 'label', 'cluster_id']), 'label')] AS label,
    v[list_position(coalesce(names, ['image_path', 'label', 'cluster_id']), 'cluster_id')] AS cluster_id
  FROM cut c LEFT JOIN head h ON c.file_id = h.file_id WHERE names IS NULL OR pos > 1
), ranked AS (SELECT *, row_number() OVER (PARTITION BY image_path ORDER BY file_id, rec_no) AS k FROM rec)"""

ORACLE = {
    "p2_found": "SELECT cluster_id FROM split_rows WHERE cluster_id IS NOT NULL GROUP BY cluster_id HAVING count(*) >= 0.01 * (SELECT count(*) FROM split_rows WHERE cluster_id IS NOT NULL)",
    "p2_profile": f"""
WITH r AS (SELECT cluster_id, {LABEL_SQL.format('label')} AS label, {SPLIT_SQL.format('split')} AS split, epoch_us(loaded_at) - epoch_us(assigned_at) AS delay FROM split_rows WHERE cluster_id IS NOT NULL)
SELECT cluster_id, count(*) AS n_rows, count(DISTINCT label) AS n_labels,
  count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val, count(*) FILTER (split = 'test') AS n_test,
  quantile_disc(delay, 0.25) AS q25, quantile_disc(delay, 0.5) AS q50, quantile_disc(delay, 0.75) AS q75
FROM r GROUP BY cluster_id""",
    "p4_found": f"WITH {_RECORDS} SELECT file_id, rec_no FROM ranked WHERE k > 1",
    "p4_groups": f"WITH {_FILES} SELECT file_id, n_bytes, starts_at, starts_at // {TARGET_BYTES} AS group_id FROM g",
    "p4_report": f"""WITH {_RECORDS}, n AS (SELECT starts_at // {TARGET_BYTES} AS group_id, count(*) AS n_files, CAST(sum(n_bytes) AS BIGINT) AS n_bytes FROM g GROUP BY 1),
k AS (SELECT group_id, count(*) AS n_records, count(*) FILTER (k = 1) AS n_kept, count(*) FILTER (k > 1) AS n_repeated FROM ranked GROUP BY 1)
SELECT n.group_id, n_files, n_bytes, coalesce(n_records, 0) AS n_records, coalesce(n_kept, 0) AS n_kept, coalesce(n_repeated, 0) AS n_repeated FROM n LEFT JOIN k USING (group_id)""",
    "p4_records": f"WITH {_RECORDS} SELECT file_id, rec_no, image_path, nullif(label, '') AS label, TRY_CAST(cluster_id AS BIGINT) AS cluster_id, group_id FROM ranked WHERE k = 1",
}

_ROWS = f"rows AS (SELECT DISTINCT row_idx, image_path, {LABEL_SQL.format('label')} AS label, cluster_id, {SPLIT_SQL.format('split')} AS split FROM split_rows)"
_CLASS_LIST = "classes AS (SELECT unnest([" + ", ".join(f"'{c}'" for c in CLASSES) + "]) AS label, generate_subscripts([" + ", ".join(f"'{c}'" for c in CLASSES) + "], 1) - 1 AS pos)"
_BITS = "fp::BIT::VARCHAR"
_LAYOUT = lambda n=None: "[" + ", ".join(f"{{'band': {i}, 'key': substr(bits, {s}, {k})}}" for i, (s, k) in enumerate(lsh.band_layout(256, lsh.THRESHOLD, n))) + "]"
_REPS = f"reps AS (SELECT fp, min(row_idx) AS rep, count(*) AS n, any_value({_BITS}) AS bits FROM fingerprints WHERE fp IS NOT NULL GROUP BY fp)"
_BANDS = lambda n=None: f"{_REPS}, bands AS (SELECT rep, fp, b.band AS band, b.key AS key FROM (SELECT rep, fp, unnest({_LAYOUT(n)}) AS b FROM reps))"
_EDGES = f"{_REPS}, edges AS (SELECT a.rep AS src, b.rep AS dst, bit_count(xor(a.fp::BIT, b.fp::BIT)) AS distance FROM reps a JOIN reps b ON a.rep < b.rep WHERE bit_count(xor(a.fp::BIT, b.fp::BIT)) <= 6)"
_COMP = _EDGES + """, ways AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
reach(x, y) AS (SELECT a, a FROM ways UNION SELECT reach.x, ways.b FROM reach JOIN ways ON reach.y = ways.a),
comp AS (SELECT x AS id, min(y) AS component FROM reach GROUP BY x)"""
_SUMMARY = _ROWS + """, cells AS (SELECT cluster_id, label, count(*) AS n FROM rows WHERE cluster_id IS NOT NULL {0} GROUP BY 1, 2),
summary AS (SELECT cluster_id, CAST(sum(n) AS BIGINT) AS n, (SELECT label FROM cells c WHERE c.cluster_id = cells.cluster_id AND label IS NOT NULL ORDER BY n DESC, label LIMIT 1) AS dominant_label FROM cells GROUP BY cluster_id)"""


def _fold(group: str, tie: str = "md5('0:' || cluster_id)", draws: str = "") -> str:
    return _SUMMARY.format("") + f""", classed AS (SELECT cluster_id, n, coalesce(dominant_label, '') AS class FROM summary), {draws}
q AS (SELECT cluster_id, n, {group} AS g, row_number() OVER (PARTITION BY {group} ORDER BY n DESC, {tie}) AS k, CAST(sum(n) OVER (PARTITION BY {group}) AS DOUBLE) AS t FROM {"drawn" if draws else "classed"}),
fold(g, k, cluster_id, a, b, c, pick) AS (
  SELECT g, 0, NULL::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, NULL::VARCHAR FROM q WHERE k = 1
  UNION ALL
  SELECT g, k, cluster_id, a + (p = 'train')::INT * n, b + (p = 'val')::INT * n, c + (p = 'test')::INT * n, p FROM (
    SELECT q.g, q.k, q.cluster_id, q.n, a, b, c, CASE
      WHEN 0.7::DOUBLE * t - a >= 0.15::DOUBLE * t - b AND 0.7::DOUBLE * t - a >= 0.15::DOUBLE * t - c THEN 'train'
      WHEN 0.15::DOUBLE * t - b >= 0.15::DOUBLE * t - c THEN 'val' ELSE 'test' END AS p
    FROM fold JOIN q ON q.g = fold.g AND q.k = fold.k + 1)
), picked AS (SELECT cluster_id, pick AS split FROM fold WHERE k > 0)"""


#: Draws of numpy's default generator, in the order of class (by its smallest cluster) and cluster.
_DRAWN = f"""draws AS (SELECT {(np.random.default_rng(0).bit_generator.random_raw(4096) >> np.uint64(11)).tolist()} AS d),
numbered AS (SELECT *, row_number() OVER (ORDER BY first, cluster_id) AS pos FROM (SELECT *, min(cluster_id) OVER (PARTITION BY class) AS first FROM classed)),
drawn AS (SELECT cluster_id, n, class, d[pos] AS tie FROM numbered, draws),"""

_GRAY = """g AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, floor((greatest(-3.0::DOUBLE, least(3.0::DOUBLE, embedding[i + 1]::DOUBLE)) + 3) * 42.5::DOUBLE) AS v FROM embeddings, (SELECT unnest(range(64)) AS i))"""
_PHASH = f"""WITH {_GRAY},
m AS (SELECT k, s AS z, sum(2 * cos(pi() * k * (2 * (8 * s + o) + 1) / 128)) AS w FROM (SELECT unnest(range(16)) AS k), (SELECT unnest(range(8)) AS s), (SELECT unnest(range(8)) AS o) GROUP BY 1, 2),
half AS (SELECT vec_id, k, x, sum(w * v) AS h FROM g JOIN m ON m.z = g.y GROUP BY ALL),
low AS (SELECT vec_id, half.k AS k, m.k AS l, round(sum(h * w), 6) AS c FROM half JOIN m ON m.z = half.x GROUP BY ALL),
bit AS (SELECT vec_id, 16 * k + l AS z, (c > median(c) OVER (PARTITION BY vec_id))::INT AS b FROM low),
byte AS (SELECT vec_id, z // 8 AS z, printf('%02X', CAST(sum(b << (7 - z % 8)) AS INT)) AS h FROM bit GROUP BY 1, 2)
SELECT vec_id, string_agg(h, '' ORDER BY z) AS fp FROM byte GROUP BY 1"""
_EVAL = f"""WITH {_GRAY},
p AS (SELECT i, a, least(a + 1, 7) AS b, z - a AS f FROM (SELECT i, z, floor(z) AS a FROM (SELECT i, greatest(0.0::DOUBLE, least(7.0::DOUBLE, (i + 0.5::DOUBLE) * 8 / 256 - 0.5::DOUBLE)) AS z FROM (SELECT unnest(range(16, 240)) AS i)))),
tall AS (SELECT u.vec_id, p.i, u.x, u.v * (1 - f) + l.v * f AS v FROM p JOIN g u ON u.y = a JOIN g l ON l.y = b AND l.vec_id = u.vec_id AND l.x = u.x),
full_size AS (SELECT u.vec_id, (u.v * (1 - f) + l.v * f) / 255 AS v FROM tall u JOIN p ON u.x = a JOIN tall l ON l.vec_id = u.vec_id AND l.i = u.i AND l.x = b),
t AS (SELECT vec_id, CAST(3 * count(*) AS INT) AS n, sum({' + '.join(f"CAST((v - {m}::DOUBLE) / {s}::DOUBLE AS FLOAT)::DOUBLE" for m, s in zip(images.MEAN, images.STD))}) AS total FROM full_size GROUP BY vec_id)
SELECT vec_id, n, round(total, 3) AS total, (row_number() OVER (ORDER BY vec_id) - 1) // 64 AS batch_id FROM t"""
_NORM = "list_transform(range(64), lambda i: (embedding[i + 1]::DOUBLE - [0.485, 0.456, 0.406, 0.5][i // 16 + 1]::DOUBLE) / [0.229, 0.224, 0.225, 0.25][i // 16 + 1]::DOUBLE)"
_SCORED = "s AS (SELECT vec_id, label AS y, list_slice(embedding, 1, 10) AS l, list_position(list_slice(embedding, 1, 10), list_max(list_slice(embedding, 1, 10))) - 1 AS pred FROM embeddings)"
_QUOTA = _ROWS + """, sizes AS (SELECT coalesce(label, '') AS class, count(*) AS n FROM rows GROUP BY 1 HAVING count(*) > 1),
tot AS (SELECT sum(n) AS total, ceil(round(0.2 * sum(n), 9)) AS n_test FROM sizes),
share AS (SELECT class, n * n_test / total AS share, floor(n * n_test / total) AS base FROM sizes, tot),
quota AS (SELECT class, base + (row_number() OVER (ORDER BY share - base DESC, class) <= (SELECT n_test FROM tot) - (SELECT sum(base) FROM share))::INT AS quota FROM share)"""

ORACLE |= {
    "scan_ext_filter": "SELECT DISTINCT row_idx, image_path FROM split_rows WHERE lower(regexp_extract(regexp_extract(image_path, '[^/]*$'), '^.+(\\.[^.]+)$', 1, 's')) IN ('.jpg', '.jpeg', '.png', '.bmp', '.ppm', '.tif', '.tiff', '.webp')",
    "scan_label_path": "SELECT DISTINCT file_id, p[-2] AS label, p[-2] || '/' || p[-1] AS image_path FROM (SELECT file_id, string_split(file_path, '/') AS p FROM index_files) WHERE len(p) >= 2",
    "class_missing_extra": f"""WITH {_ROWS}, {_CLASS_LIST}, have AS (SELECT DISTINCT label FROM rows WHERE label IS NOT NULL)
SELECT 'missing' AS kind, label, row_number() OVER (ORDER BY pos) - 1 AS pos FROM classes WHERE label NOT IN (SELECT label FROM have)
UNION ALL SELECT 'extra', label, row_number() OVER (ORDER BY label) - 1 FROM have WHERE label NOT IN (SELECT label FROM classes)""",
    "scan_row_order": f"WITH {_CLASS_LIST}, f AS (SELECT DISTINCT {LABEL_SQL.format('label')} AS label, image_path FROM split_rows WHERE image_path IS NOT NULL) SELECT label, image_path, row_number() OVER (ORDER BY pos, image_path) - 1 AS row_idx FROM f JOIN classes USING (label)",
    "flat_prefix_label": "WITH c AS (SELECT unnest(" + str(list(FLAT_CLASSES)) + """) AS label),
m AS (SELECT p_partkey, p_name, label, row_number() OVER (PARTITION BY p_partkey ORDER BY (lower(p_name) = label) DESC, length(label) DESC) AS k FROM part JOIN c ON starts_with(lower(regexp_replace(p_name, '^(.+)\\.[^.]+$', '\\1')), label))
SELECT p_partkey, p_name, label FROM m WHERE k = 1""",
    "fingerprint_256": """
WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[ \t\n\f\r]+')) AS word FROM documents),
n AS (SELECT doc_id, ('0x' || substr(md5(word), 1, 2))::INT AS bucket, count(*) AS n FROM w WHERE word <> '' GROUP BY 1, 2),
s AS (SELECT doc_id, b AS bucket, coalesce(n, 0) AS n FROM (SELECT doc_id, unnest(range(256)) AS b FROM documents WHERE text IS NOT NULL) d LEFT JOIN n USING (doc_id) WHERE n.bucket = b OR n.bucket IS NULL),
full_s AS (SELECT d.doc_id, d.b, coalesce(n.n, 0) AS n FROM (SELECT doc_id, unnest(range(256)) AS b FROM documents WHERE text IS NOT NULL) d LEFT JOIN n ON n.doc_id = d.doc_id AND n.bucket = d.b),
med AS (SELECT doc_id, median(n) AS m FROM full_s GROUP BY doc_id),
bits AS (SELECT doc_id, string_agg(CASE WHEN n > m THEN '1' ELSE '0' END, '' ORDER BY b) AS bits FROM full_s JOIN med USING (doc_id) GROUP BY doc_id)
SELECT doc_id AS row_idx, bits FROM documents LEFT JOIN bits USING (doc_id)""",
    "dropped_counts": "SELECT count(*) AS scanned, count(*) - count(fp) AS dropped, count(fp) AS kept FROM fingerprints",
    "exact_dup_reps": f"WITH {_REPS} SELECT rep, n FROM reps",
    "lsh_bands": f"WITH {_BANDS()} SELECT rep, band, key FROM bands",
    "lsh_candidates": f"WITH {_BANDS()} SELECT DISTINCT a.rep AS src, b.rep AS dst FROM bands a JOIN bands b ON a.band = b.band AND a.key = b.key AND a.rep < b.rep",
    "near_dup_edges": f"WITH {_EDGES} SELECT src, dst, distance FROM edges",
    "lsh_underbanded": f"WITH {_BANDS(3)} SELECT DISTINCT a.rep AS src, b.rep AS dst, bit_count(xor(a.fp::BIT, b.fp::BIT)) AS distance FROM bands a JOIN bands b ON a.band = b.band AND a.key = b.key AND a.rep < b.rep WHERE bit_count(xor(a.fp::BIT, b.fp::BIT)) <= 6",
    "dup_components": f"WITH RECURSIVE {_COMP} SELECT id, component FROM comp",
    "cluster_ids": f"WITH RECURSIVE {_COMP}, c AS (SELECT DISTINCT f.row_idx, coalesce(component, rep) AS comp FROM fingerprints f JOIN reps ON f.fp = reps.fp LEFT JOIN comp ON id = rep) SELECT row_idx, dense_rank() OVER (ORDER BY comp) - 1 AS cluster_id FROM c",
    "cluster_size_label": f"WITH {_SUMMARY.format('')} SELECT cluster_id, n, dominant_label FROM summary",
    "split_stratified": f"WITH RECURSIVE {_fold('class')} SELECT row_idx, rows.cluster_id, picked.split FROM rows LEFT JOIN picked ON rows.cluster_id = picked.cluster_id",
    "split_global": f"WITH RECURSIVE {_fold('1')} SELECT cluster_id, split FROM picked",
    "split_pcg64": f"WITH RECURSIVE {_fold('class', 'tie', _DRAWN)} SELECT cluster_id, split FROM picked",
    "phash_vectors": _PHASH,
    "image_batches": _EVAL,
    "index_batches": f"""WITH {_ROWS}, {_CLASS_LIST}, code AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INT) AS y FROM classes)
SELECT '/data/images/' || image_path AS path, cluster_id, y, (row_number() OVER (ORDER BY image_path NULLS FIRST, r.label NULLS FIRST, cluster_id NULLS FIRST) - 1) // 128 AS batch_id FROM rows r LEFT JOIN code c ON r.label = c.label WHERE split = 'val'""",
    "results_summary": f"""WITH r AS (SELECT DISTINCT model, {LABEL_SQL.format('family')} AS family, seed, best_val_acc, test_acc FROM runs),
s AS (SELECT family, model, round(avg(test_acc), 9) AS test_acc_mean, count(DISTINCT seed) AS n_seeds FROM r GROUP BY 1, 2) SELECT family, model, seed, best_val_acc, test_acc, test_acc_mean, n_seeds FROM r JOIN s USING (family, model)""",
    "leakage_offenders": f"WITH {_ROWS} SELECT cluster_id, count(DISTINCT split) AS n_splits FROM rows WHERE cluster_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1",
    "cluster_stats": f"""WITH {_ROWS}, z AS (SELECT cluster_id, count(*) AS n FROM rows GROUP BY 1)
SELECT count(cluster_id) AS n_clusters, count(*) FILTER (cluster_id IS NOT NULL AND n > 1) AS n_multiple, CAST(sum(n) FILTER (cluster_id IS NOT NULL AND n > 1) AS BIGINT) AS rows_multiple, max(n) FILTER (cluster_id IS NOT NULL) AS largest,
  CAST(sum(n) AS BIGINT) AS n_rows, 100.0::DOUBLE * (sum(n) FILTER (cluster_id IS NOT NULL AND n > 1))::DOUBLE / sum(n)::DOUBLE AS percent FROM z""",
    "split_totals": f"WITH {_ROWS} SELECT s AS split, count(split) AS n, 100.0::DOUBLE * count(split)::DOUBLE / (SELECT count(*) FROM rows)::DOUBLE AS percent FROM (SELECT unnest(['train', 'val', 'test']) AS s) LEFT JOIN rows ON split = s GROUP BY s",
    "label_split_pivot": f"WITH {_ROWS} SELECT label, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test, count(split) AS total FROM rows WHERE label IS NOT NULL GROUP BY label",
    "random_split_exact": f"WITH {_QUOTA} SELECT row_idx, label, CASE WHEN k <= coalesce(quota, 0) THEN 'test' ELSE 'train' END AS split FROM (SELECT row_idx, label, coalesce(label, '') AS class, row_number() OVER (PARTITION BY coalesce(label, '') ORDER BY md5('0:' || row_idx)) AS k FROM rows) r LEFT JOIN quota q ON q.class = r.class",
    "sample_512": f"WITH {_ROWS} SELECT row_idx, label FROM rows ORDER BY md5('0:' || row_idx) LIMIT 512",
    "per_class_20": f"WITH {_ROWS} SELECT row_idx, label FROM (SELECT row_idx, label, row_number() OVER (PARTITION BY label ORDER BY md5('0:' || row_idx)) AS k FROM rows WHERE label IS NOT NULL) WHERE k <= 20",
    "frame_checks": f"WITH {_ROWS} SELECT count(*) AS n_rows, count(DISTINCT label) AS n_labels FROM rows",
    "label_encode": f"WITH {_ROWS}, {_CLASS_LIST} SELECT row_idx, r.label, y FROM rows r LEFT JOIN (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INT) AS y FROM classes) c ON r.label = c.label",
    "batches_train": f"WITH {_ROWS}, t AS (SELECT row_idx, row_number() OVER (ORDER BY md5('0:' || row_idx)) - 1 AS k, count(*) OVER () AS n FROM rows WHERE split = 'train') SELECT row_idx, k // 128 AS batch_id FROM t WHERE k < n // 128 * 128",
    "batches_eval": f"WITH {_ROWS} SELECT row_idx, (row_number() OVER (ORDER BY row_idx) - 1) // 128 AS batch_id FROM rows WHERE split = 'val'",
    "channel_normalize": f"SELECT vec_id, round(list_sum({_NORM}), 6) AS total, round(({_NORM})[18], 9) AS x17 FROM embeddings",
    "argmax_prediction": f"WITH {_SCORED} SELECT vec_id, y, CAST(pred AS INT) AS pred FROM s",
    "argmax_accuracy": f"WITH {_SCORED} SELECT count(*) AS n, avg((y = pred)::INT) AS accuracy FROM s",
    "smoothed_ce": f"""WITH {_SCORED}, e AS (SELECT vec_id, y, l, list_max(l)::DOUBLE + ln(list_sum(list_transform(l, lambda x: exp(x::DOUBLE - list_max(l)::DOUBLE)))) AS lse FROM s)
SELECT vec_id, round(0.9 * (lse - l[y + 1]::DOUBLE) + 0.1 * (lse - list_sum(list_transform(l, lambda x: x::DOUBLE)) / 10), 6) AS loss FROM e""",
    "weighted_loss": "SELECT model, round(sum(train_loss * (epoch + 1)) / sum(epoch + 1) FILTER (train_loss IS NOT NULL), 9) AS loss FROM (SELECT DISTINCT * FROM run_history) GROUP BY model",
    "confusion_matrix": f"WITH {_SCORED} SELECT CAST(a.y AS INT) AS y, CAST(b.p AS INT) AS pred, count(s.vec_id) AS n FROM (SELECT unnest(range(10)) AS y) a CROSS JOIN (SELECT unnest(range(10)) AS p) b LEFT JOIN s ON s.y = a.y AND s.pred = b.p GROUP BY 1, 2",
    "confusion_wide": f"WITH {_SCORED} SELECT CAST(a.y AS INT) AS y, " + ", ".join(f"count(s.vec_id) FILTER (pred = {k}) AS p{k}" for k in range(10)) + " FROM (SELECT unnest(range(10)) AS y) a LEFT JOIN s ON s.y = a.y GROUP BY 1",
    "lr_schedule": "SELECT CAST(e AS INT) AS epoch, round(f, 12) AS factor, round(f * 5e-4, 12) AS lr FROM (SELECT e, CASE WHEN e < 3 THEN (e + 1) / 3.0::DOUBLE ELSE 0.5::DOUBLE * (1 + cos(pi() * least(1.0::DOUBLE, (e - 3) / 37.0::DOUBLE))) END AS f FROM (SELECT unnest(range(40)) AS e))",
    "best_epoch": "SELECT model, seed, epoch, val_acc FROM (SELECT *, row_number() OVER (PARTITION BY model, seed ORDER BY val_acc DESC, epoch) AS k FROM run_history WHERE val_acc IS NOT NULL) WHERE k = 1",
    "seed_summary": f"SELECT {LABEL_SQL.format('family')} AS family, model, round(avg(test_acc), 9) AS test_acc_mean, round(stddev_samp(test_acc), 9) AS test_acc_std, round(avg(best_val_acc), 9) AS val_acc_mean, count(DISTINCT seed) AS n_seeds FROM (SELECT DISTINCT model, lower(family) AS family, seed, best_val_acc, test_acc FROM runs) GROUP BY 1, 2",
    "model_seed_grid": "SELECT model, CAST(s AS INT) AS seed, model || '_seed' || s AS tag FROM (SELECT DISTINCT model FROM runs WHERE model IS NOT NULL), (SELECT unnest([0, 1, 2]) AS s)",
    "decay_groups": "SELECT p_partkey, p_type || CASE WHEN p_size % 2 = 0 THEN '.bias' ELSE '.weight' END AS name, p_size % 3 AS ndim, NOT (p_size % 3 = 1 OR p_size % 2 = 0) AS decay FROM part",
}
