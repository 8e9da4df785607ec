"""Queries over the test tables for the operators of this folder, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpwork.functions.text import label_of, split_of
from kelpwork.llm.cube import ProportionSample
from kelpwork.llm.groups import linked_groups
from kelpwork.llm.leaks import leaked_items
from kelpwork.llm.overlap import SplitOverlap
from kelpwork.llm.quality import not_prose, text_statistics
from kelpwork.llm.stratify import RATIOS, UNITS, grouped_split
from kelpwork.llm.tokens import token_ids
from kelpwork.plans.shared import Stage

#: A pair of paths is a match up to this distance.
MATCH_DISTANCE = 6


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _sampled(spark: SparkSession, sf: str) -> ProportionSample:
    return ProportionSample(_table(spark, sf, "split_rows"), _table(spark, sf, "sample_targets"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _sampled(spark, sf).report().where("short").select("plan_id", "split", "label").distinct()


def p1_sample(spark: SparkSession, sf: str) -> DataFrame:
    return _sampled(spark, sf).sample()


def p1_report(spark: SparkSession, sf: str) -> DataFrame:
    return _sampled(spark, sf).report()


def p1_wanted(spark: SparkSession, sf: str) -> DataFrame:
    """The columns of the report that no draw decides."""
    return p1_report(spark, sf).select("plan_id", "split", "label", F.round("wanted", 6).alias("wanted"), "available", "short")


def _overlap(spark: SparkSession, sf: str) -> SplitOverlap:
    return SplitOverlap(_table(spark, sf, "split_rows"), _table(spark, sf, "fingerprints"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _overlap(spark, sf).pairs()


def p3_report(spark: SparkSession, sf: str) -> DataFrame:
    return _overlap(spark, sf).report()


def p3_links(spark: SparkSession, sf: str) -> DataFrame:
    return _overlap(spark, sf).links()


def _split_input(spark: SparkSession, sf: str) -> DataFrame:
    rows = _table(spark, sf, "split_rows")
    return rows.select("row_idx", "cluster_id", label_of(F.col("label")).alias("label"), split_of(F.col("split")).alias("split"))


def _assigned(spark: SparkSession, sf: str) -> DataFrame:
    return grouped_split(_split_input(spark, sf), "row_idx", ["cluster_id"], "label", "split")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    spread = _assigned(spark, sf).where("component LIKE 'k:%' AND n_current > 1 AND assigned IS NOT NULL")
    return spread.select(F.substring("component", 3, 40).cast("long").alias("cluster_id"))


def p5_assignment(spark: SparkSession, sf: str) -> DataFrame:
    return _assigned(spark, sf).select("component", "n_rows", "assigned")


def _placed(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of component, label and the split that the component was assigned to."""
    rows = _split_input(spark, sf).dropDuplicates(["row_idx"])
    component = F.coalesce(F.concat(F.lit("k:"), F.col("cluster_id").cast("string")), F.concat(F.lit("row:"), F.col("row_idx").cast("string")))
    cells = rows.groupBy(component.alias("component"), "label").agg(F.count(F.lit(1)).alias("n"))
    return cells.join(_assigned(spark, sf), "component")


def p5_balance(spark: SparkSession, sf: str) -> DataFrame:
    """Per label and split: rows, share, and the share that was asked for."""
    counts = _placed(spark, sf).groupBy("label", "assigned").agg(F.sum("n").alias("n_rows"))
    totals = counts.groupBy(F.col("label").alias("of")).agg(F.sum("n_rows").alias("total"))
    asked = F.create_map(*[F.lit(x) for pair in RATIOS.items() for x in pair])
    return counts.join(totals, F.col("label").eqNullSafe(F.col("of"))).select("label", "assigned", "n_rows", (F.col("n_rows") / F.col("total")).alias("share"), asked[F.col("assigned")].alias("asked"))


def p5_checks(spark: SparkSession, sf: str) -> DataFrame:
    """What holds of every assignment: all rows and components are placed, none in two splits, and no label misses a ratio by
    more than its largest component and two bundles."""
    placed = Stage(spark, "p5_checks").write(_placed(spark, sf), "placed")
    whole = placed.agg(F.sum("n").alias("n_rows"), F.count_distinct("component").alias("n_components"))
    spread = placed.groupBy("component").agg(F.count_distinct("assigned").alias("n")).agg(F.count_if(F.col("n") != 1).alias("n_spread"))
    labels = placed.groupBy("label").agg(F.sum("n").alias("total"), F.max("n").alias("most"), *[F.coalesce(F.sum(F.when(F.col("assigned") == s, F.col("n"))), F.lit(0)).alias(s) for s in RATIOS])
    miss = F.greatest(*[F.abs(F.col(s) - F.col("total") * share) for s, share in RATIOS.items()])
    off = labels.agg(F.count_if(miss > F.col("most") + F.ceil(2 * F.col("total") / UNITS)).alias("n_labels_off"))
    return whole.crossJoin(spread).crossJoin(off)  # one row each


def _groups(spark: SparkSession, sf: str) -> DataFrame:
    return linked_groups(_table(spark, sf, "match_pairs").where(F.col("distance") <= MATCH_DISTANCE), "path_a", "path_b")


def p6_groups(spark: SparkSession, sf: str) -> DataFrame:
    return _groups(spark, sf).select(F.col("name").alias("image_path"), "group_id")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _groups(spark, sf).where("name <> group_id").select(F.col("group_id").alias("first_path"), F.col("name").alias("image_path"))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return token_ids(_table(spark, sf, "documents"), "doc_id", "text")


def p8_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leaked_items(_table(spark, sf, "documents"), _table(spark, sf, "eval_items"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return p8_leaks(spark, sf).where("exact").select("doc_id", "item_id")


def p9_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return text_statistics(_table(spark, sf, "documents"), _table(spark, sf, "common_words"))


def p9_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The statistics that need no word list and no estimation, of documents that are not blank."""
    held = p9_statistics(spark, sf).where("distance IS NOT NULL")
    return held.select("doc_id", "n_words", *[F.round(c, 9).alias(c) for c in ("mean_word_length", "symbol_share", "punctuated_lines")])


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return not_prose(p9_statistics(spark, sf)).select("doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_sample, p1_report, p1_wanted, p3_found, p3_report, p3_links, p5_found, p5_assignment, p5_balance, p5_checks, p6_found, p6_groups, p7_ids, p8_found, p8_leaks, p9_found, p9_counts, p9_statistics)}

_SPLIT = """CASE WHEN lower(trim({0}, E' \\t\\r\\n')) IN ('train', 'training') THEN 'train'
  WHEN lower(trim({0}, E' \\t\\r\\n')) IN ('val', 'valid', 'validation') THEN 'val'
  WHEN lower(trim({0}, E' \\t\\r\\n')) IN ('test', 'testing') THEN 'test' END"""
_LABEL = "lower(trim({0}, E' \\t\\r\\n'))"

_PAIRS = f"""
u AS (
  SELECT DISTINCT s.row_idx, s.cluster_id, s.source, {_SPLIT.format('s.split')} AS split, f.fp,
    nullif(regexp_replace(regexp_replace(lower(trim(url_decode(image_path), E' \\t\\r\\n')), '[\\\\/]+', '/', 'g'), '^(\\.?/)+', ''), '') AS path
  FROM split_rows s LEFT JOIN (SELECT row_idx, min(fp) AS fp FROM fingerprints GROUP BY row_idx) f USING (row_idx)
), t AS (SELECT * FROM u WHERE split = 'train'), e AS (SELECT * FROM u WHERE split IN ('val', 'test')),
codes AS (
  SELECT a.fp AS fa, b.fp AS fb FROM (SELECT DISTINCT fp FROM t WHERE fp IS NOT NULL) a, (SELECT DISTINCT fp FROM e WHERE fp IS NOT NULL) b
  WHERE bit_count(xor(a.fp::BIT, b.fp::BIT)) <= 6
), pairs AS (
  SELECT t.row_idx AS a, e.row_idx AS b FROM t JOIN e ON t.cluster_id = e.cluster_id
  UNION SELECT t.row_idx, e.row_idx FROM t JOIN e ON t.path = e.path
  UNION SELECT t.row_idx, e.row_idx FROM codes JOIN t ON t.fp = fa JOIN e ON e.fp = fb
)"""

_CLOSURE = """
m AS (SELECT path_a AS a, path_b AS b FROM match_pairs WHERE distance <= 6 AND path_a IS NOT NULL AND path_b IS NOT NULL),
s AS (SELECT a, b FROM m UNION SELECT b, a FROM m),
r(x, y) AS (SELECT a, a FROM s UNION SELECT r.x, s.b FROM r JOIN s ON r.y = s.a),
g AS (SELECT x AS image_path, min(y) AS group_id FROM r GROUP BY x)"""

ORACLE = {
    "p1_found": f"""
WITH r AS (SELECT DISTINCT row_idx, {_SPLIT.format('split')} AS split, {_LABEL.format('label')} AS label FROM split_rows),
n AS (SELECT split, label, count(DISTINCT row_idx) AS n FROM r GROUP BY 1, 2)
SELECT DISTINCT t.plan_id, t.split, t.label FROM sample_targets t LEFT JOIN n ON t.split = n.split AND t.label = n.label
WHERE coalesce(n.n, 0) < greatest(coalesce(t.min_rows, 0), coalesce(t.target_share * t.sample_size, 0))""",
    "p1_wanted": f"""
WITH r AS (SELECT DISTINCT row_idx, {_SPLIT.format('split')} AS split, {_LABEL.format('label')} AS label FROM split_rows),
n AS (SELECT split, label, count(DISTINCT row_idx) AS n FROM r GROUP BY 1, 2),
w AS (SELECT plan_id, t.split, t.label, greatest(coalesce(t.min_rows, 0)::DOUBLE, coalesce(t.target_share * t.sample_size, 0)) AS wanted, coalesce(n, 0) AS available FROM sample_targets t LEFT JOIN n ON t.split = n.split AND t.label = n.label)
SELECT plan_id, split, label, round(wanted, 6) AS wanted, available, available < wanted AS short FROM w""",
    "p5_checks": "SELECT count(DISTINCT row_idx) AS n_rows, count(DISTINCT coalesce('k:' || cluster_id, 'row:' || row_idx)) AS n_components, 0::BIGINT AS n_spread, 0::BIGINT AS n_labels_off FROM split_rows",
    "p3_found": f"WITH {_PAIRS} SELECT least(a, b) AS row_a, greatest(a, b) AS row_b FROM pairs",
    "p3_links": f"WITH {_PAIRS} SELECT b AS row_idx, split, count(*) AS n_links FROM pairs JOIN e ON b = row_idx GROUP BY 1, 2",
    "p3_report": f"""WITH {_PAIRS}, k AS (SELECT b, count(*) AS n FROM pairs GROUP BY b)
SELECT split, source, count(*) AS n_rows, count(n) AS n_overlapping, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_pairs FROM e LEFT JOIN k ON b = row_idx GROUP BY 1, 2""",
    "p5_found": f"SELECT cluster_id FROM split_rows WHERE cluster_id IS NOT NULL GROUP BY cluster_id HAVING count(DISTINCT {_SPLIT.format('split')}) > 1",
    "p6_groups": f"WITH RECURSIVE {_CLOSURE} SELECT image_path, group_id FROM g",
    "p6_found": f"WITH RECURSIVE {_CLOSURE} SELECT group_id AS first_path, image_path FROM g WHERE group_id <> image_path",
    "p9_counts": r"""
WITH t AS (SELECT doc_id, regexp_replace(nfc_normalize(text), '\p{Cf}', '', 'g') AS t FROM documents WHERE regexp_replace(text, '[\p{Z}\x09-\x0d\x1c-\x1f\x{85}]', '', 'g') <> ''),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[\p{L}\p{M}]+') AS words, list_filter(regexp_split_to_array(t, '[\r\n]'), lambda x: regexp_replace(x, '[\p{Z}\x09-\x0d\x1c-\x1f\x{85}]', '', 'g') <> '') AS lines FROM t)
SELECT doc_id, len(words) AS n_words, round(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::DOUBLE / greatest(1, len(words))::DOUBLE, 9) AS mean_word_length,
  round(length(regexp_replace(t, '[\p{L}\p{M}\p{Nd}\p{Z}\x09-\x0d\x1c-\x1f\x{85}]', '', 'g'))::DOUBLE / greatest(1, length(t))::DOUBLE, 9) AS symbol_share,
  round(len(list_filter(lines, lambda x: regexp_matches(x, '[.!?:;…][\p{Z}\x09-\x0d\x1c-\x1f\x{85}"''»”’)\]“]*$')))::DOUBLE / greatest(1, len(lines))::DOUBLE, 9) AS punctuated_lines FROM w""",
}
