"""Records of evaluation splits that also occur in the training split: as cluster, as file, or as nearly equal code.

Codes within a Hamming radius r agree in at least one of r + 1 segments, so segments are the join keys and the distance
is verified on the bits. The three kinds of link are made disjoint by construction (same cluster; same file but not the
same cluster; near codes but neither), so the pairs need no global distinct. Rows of one cluster, of one file and
cluster, or of one code and cluster are a class; links join classes, and only the list of pairs expands the members, in
blocks, so that a class of any size is spread over many tasks. Counts come from the sizes of classes alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpwork.functions.text import split_of
from kelpwork.operators.fingerprint import distance_of, words64
from kelpwork.plans.shared import Stage
from kelpwork.plans.skew import blocked_join, hot_lookup

RADIUS = 6
CODE_BYTES = 32
#: Members of one block at the expansion.
BLOCK = 1024
#: Pairs that a task of the expansion makes, about.
TASK_PAIRS = 20_000_000


def file_key(path: Column) -> Column:
    """A path without what its spellings differ in: percent-encoding, case, outer white space, kind and number of slashes,
    a leading ``/`` or ``./``. Null for null and for a path of which nothing is left."""
    plain = F.url_decode(F.replace(F.regexp_replace(path, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B")))
    plain = F.lower(F.regexp_replace(plain, r"(?U)^\s+|\s+$", ""))
    plain = F.regexp_replace(F.regexp_replace(plain, r"[\\/]+", "/"), r"^(?:\.?/)+", "")
    return F.nullif(plain, F.lit(""))


def segments(n_bytes: int, parts: int) -> list[tuple[int, int]]:
    """(start from 1, length) of contiguous parts of a code; the first ones are longer by a byte where it doesn't divide."""
    base, more = divmod(n_bytes, parts)
    out, at = [], 1
    for i in range(parts):
        length = base + (i < more)
        out.append((at, length))
        at += length
    return out


def near_codes(codes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(code_a, code_b)`` with code_a in train, code_b in eval and at most ``radius`` differing bits.

    ``codes`` has one row per distinct code: code, train, eval (whether it occurs there) and ``home``, the one cluster of
    all its rows or null. Pairs with the same home are left out: their rows are linked by the cluster.
    """
    cut = F.array(*[F.struct(F.lit(i).alias("part"), F.substring("code", s, n).alias("key")) for i, (s, n) in enumerate(segments(CODE_BYTES, radius + 1))])
    keyed = codes.select("code", "train", "eval", "home", F.explode(cut).alias("c")).select("code", "train", "eval", "home", "c.part", "c.key")
    a = keyed.where("train").select("part", "key", F.col("code").alias("code_a"), F.col("home").alias("home_a"))
    b = keyed.where("eval").select("part", "key", F.col("code").alias("code_b"), F.col("home").alias("home_b"))
    # words are made of the pairs that meet, so that only the codes travel; codes that share a segment (blank pictures) meet in blocks
    far_home = F.col("home_a").isNull() | F.col("home_b").isNull() | (F.col("home_a") != F.col("home_b"))
    near = distance_of(words64(F.col("code_a")), words64(F.col("code_b"))) <= radius
    return blocked_join(a, b, ["part", "key"], "code_a", "code_b").where(far_home & near).select("code_a", "code_b").distinct()


def _cluster_key() -> Column:
    """The cluster as text, empty for none; two rows without a cluster are not in the same one."""
    return F.when(F.col("cluster").isNull(), "").otherwise(F.concat(F.lit("c"), F.col("cluster").cast("string")))


def _not_same(a: str, b: str) -> Column:
    return (F.col(a) == "") | (F.col(a) != F.col(b))


def _expanded(links: DataFrame, units: DataFrame, key: Column, n_units: int, other_path: bool = False) -> DataFrame:
    """Pairs of row ids, smaller first, of the classes that ``links`` (ka, na, kb, nb) joins: ka of train rows, kb of
    others, with their numbers of rows. ``key`` gives the class of a row.

    Members are put together in blocks, and each pair of blocks is a row of its own when it is expanded, wherever it
    falls by hash: a class of any size is spread over as many tasks as its pairs need.
    """
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    row = F.struct("row_id", "path") if other_path else F.struct("row_id")
    members = units.select("train", key.alias("k"), row.alias("row"))
    n_pairs = links.agg(F.sum(F.col("na").cast("double") * F.col("nb"))).first()[0] or 0
    parts = int(min(100_000, max(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_pairs // TASK_PAIRS)))

    def side(train: bool, k: str, n: str, place: str, rows: str) -> DataFrame:
        wanted = links.select(F.col(k).alias("k"), blocks(n).alias("__n")).distinct()
        held = hot_lookup(members.where(F.col("train") == train), "k", wanted, n_units, "inner")
        at = F.pmod(F.xxhash64("row.row_id"), F.col("__n")).cast("int").alias(place)
        return held.groupBy(F.col("k").alias(k), at).agg(F.collect_list("row").alias(rows))

    met = links.select("ka", "kb", F.explode(F.sequence(F.lit(0), blocks("na") - 1)).alias("i"), blocks("nb").alias("n_j"))
    met = met.select("ka", "kb", "i", F.explode(F.sequence(F.lit(0), F.col("n_j") - 1)).alias("j"))
    met = met.join(side(True, "ka", "na", "i", "a"), ["ka", "i"]).join(side(False, "kb", "nb", "j", "b"), ["kb", "j"])
    met = met.repartition(parts, "ka", "i", "kb", "j").select("a", "b")  # few bytes make many pairs, so the number is given
    pairs = met.select(F.explode("a").alias("a"), "b").select("a", F.explode("b").alias("b"))
    if other_path:
        pairs = pairs.where(F.col("a.path").isNull() | F.col("b.path").isNull() | (F.col("a.path") != F.col("b.path")))
    return pairs.select(F.least("a.row_id", "b.row_id").alias("row_a"), F.greatest("a.row_id", "b.row_id").alias("row_b"))


class SplitOverlap:
    """Overlap of train with val and test in ``rows`` (row_idx, image_path, cluster_id, split, source) and
    ``prints`` (row_idx, fp).

    A null cluster, path or code links nothing; codes of another length than 32 bytes are no codes. Rows of no split take
    no part; rows repeated under one row_idx count once. Empty tables give empty results.
    """

    def __init__(self, rows: DataFrame, prints: DataFrame, radius: int = RADIUS):
        self.stage = Stage(rows.sparkSession, "overlap")
        self.radius = radius
        one = rows.select(F.col("row_idx").cast("long").alias("row_id"), F.col("cluster_id").alias("cluster"), file_key(F.col("image_path")).alias("path"), split_of(F.col("split")).alias("split"), "source")
        one = one.where("row_id IS NOT NULL AND split IS NOT NULL").dropDuplicates(["row_id"])
        codes = prints.where(F.octet_length("fp") == CODE_BYTES).groupBy(F.col("row_idx").cast("long").alias("row_id")).agg(F.min("fp").alias("code"))
        units = one.join(codes, "row_id", "left").withColumn("train", F.col("split") == "train").withColumn("home", _cluster_key())
        self.units, self.n_units = self.stage.counted(units, "units")
        numbers = [F.count_if("train").alias("na"), F.count_if(~F.col("train")).alias("nb")]
        # rows of one file, or of one code, by cluster: pairs within a cluster are never made
        self.clusters = self.stage.write(self.units.where("cluster IS NOT NULL").groupBy("home").agg(*numbers).where("na > 0 AND nb > 0"), "clusters")
        self.files = self.stage.write(self.units.where("path IS NOT NULL").groupBy("path", "home").agg(*numbers), "files")
        self.prints = self.stage.write(self.units.where("code IS NOT NULL").groupBy("code", "home").agg(*numbers), "prints")
        only_home = F.when((F.count(F.lit(1)) == 1) & (F.min("home") != ""), F.min("home")).alias("home")
        each = self.stage.write(self.prints.groupBy("code").agg((F.sum("na") > 0).alias("train"), (F.sum("nb") > 0).alias("eval"), only_home), "codes")
        self.near, self.n_near = self.stage.counted(near_codes(each, radius), "near")

    def pairs(self) -> DataFrame:
        """``(row_a, row_b)``: every pair of a train row and a val or test row that is linked, smaller id first, once."""
        units, n_units = self.units, self.n_units

        def classes(kind: str, part: DataFrame, train: bool, x: str) -> DataFrame:
            n = "na" if train else "nb"
            return part.where(f"{n} > 0").select(F.col(kind).alias(f"{kind}_{x}"), F.struct(kind, "home").alias(f"k{x}"), n, F.col("home").alias(f"home_{x}"))

        by_cluster = self.clusters.select(F.col("home").alias("ka"), "na", F.col("home").alias("kb"), "nb")
        a, b = classes("path", self.files, True, "a").withColumnRenamed("path_a", "path"), classes("path", self.files, False, "b").withColumnRenamed("path_b", "path")
        by_path = blocked_join(a, b, ["path"], "home_a", "home_b").where(_not_same("home_a", "home_b"))
        by_code = self.near.join(classes("code", self.prints, True, "a"), "code_a").join(classes("code", self.prints, False, "b"), "code_b").where(_not_same("home_a", "home_b"))
        links = [self.stage.write(x.select("ka", "na", "kb", "nb"), name) for x, name in ((by_cluster, "by_cluster"), (by_path, "by_path"), (by_code, "by_code"))]
        out = _expanded(links[0], units, F.col("home"), n_units)
        out = out.unionByName(_expanded(links[1], units.where("path IS NOT NULL"), F.struct("path", "home"), n_units))
        return out.unionByName(_expanded(links[2], units.where("code IS NOT NULL"), F.struct("code", "home"), n_units, other_path=True))

    def counted(self) -> DataFrame:
        """``(row_id, split, source, n_links)`` of every val and test row; no pair of rows is made.

        Links by cluster are the cluster's train rows; by file those of the file, less the ones in the row's own cluster; by code those
        of all near codes, less the ones in the row's own cluster, less the ones of the row's own file in other clusters.
        """
        rows = self.units.where("NOT train").select("row_id", "split", "source", "home", "path", "code")
        own = F.when(F.col("home") != "", F.col("na")).otherwise(0)
        of_file = self.files.groupBy("path").agg(F.sum("na").alias("all"))
        by_file = self.files.where("nb > 0").join(of_file, "path").select(F.struct("path", "home").alias("file"), (F.col("all") - own).alias("n_file")).where("n_file > 0")
        by_file = self.stage.write(by_file, "n_file")
        # train rows of near codes
        of_code = self.prints.groupBy("code").agg(F.sum("na").alias("n")).select(F.col("code").alias("code_a"), "n")
        by_code = hot_lookup(self.near, "code_a", of_code, self.n_near, "inner").groupBy("code_b").agg(F.sum("n").alias("n_code"))
        # of these, in the cluster of the row
        homes = self.prints.where("home <> ''")
        evals = blocked_join(self.near, homes.where("nb > 0").select(F.col("code").alias("code_b"), "home"), ["code_b"], "code_a", "home")
        at_home = evals.join(homes.where("na > 0").select(F.col("code").alias("code_a"), "home", "na"), ["code_a", "home"])
        at_home = at_home.groupBy(F.struct(F.col("code_b").alias("code"), "home").alias("place")).agg(F.sum("na").alias("n_home"))
        # of these, under the name of the row's file, in other clusters
        named = rows.where("path IS NOT NULL AND code IS NOT NULL").withColumn("file", F.struct("path", "home"))
        named = hot_lookup(named, "file", by_file, self.n_units, "inner").select(F.col("code").alias("code_b"), "home", "path").distinct()
        named = blocked_join(self.near, named, ["code_b"], "code_a", "path")
        trains = self.units.where("train AND path IS NOT NULL AND code IS NOT NULL").groupBy(F.col("code").alias("code_a"), "path", F.col("home").alias("home_a")).agg(F.count(F.lit(1)).alias("n"))
        same_file = blocked_join(named, trains, ["code_a", "path"], "home", "home_a").where(_not_same("home", "home_a"))
        same_file = same_file.groupBy(F.struct(F.col("code_b").alias("code"), "home", "path").alias("spot")).agg(F.sum("n").alias("n_same"))

        out = hot_lookup(rows, "home", self.clusters.select("home", F.col("na").alias("n_cluster")), self.n_units)
        for key, table in ((F.struct("path", "home").alias("file"), by_file), (F.struct("code", "home").alias("place"), at_home), (F.struct("code", "home", "path").alias("spot"), same_file)):
            name = table.columns[0]
            out = hot_lookup(out.withColumn(name, key), name, self.stage.write(table, f"by_{name}"), self.n_units).drop(name)
        out = hot_lookup(out, "code", by_code.withColumnRenamed("code_b", "code"), self.n_units)
        n = lambda c: F.coalesce(F.col(c), F.lit(0))
        return out.select("row_id", "split", "source", (n("n_cluster") + n("n_file") + n("n_code") - n("n_home") - n("n_same")).alias("n_links"))

    def report(self) -> DataFrame:
        """Per eval split and source: rows of that split and source, how many of them also occur in train, and pairs.

        A null source is a source of its own.
        """
        return self.counted().groupBy("split", "source").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("n_links") > 0).alias("n_overlapping"), F.sum("n_links").alias("n_pairs"))

    def links(self) -> DataFrame:
        """One row per val or test row that also occurs in train: ``(row_idx, split, n_links)``."""
        return self.counted().where("n_links > 0").select(F.col("row_id").alias("row_idx"), "split", "n_links")
