"""Reading CSV texts of the index (image_path, label, cluster_id) held in a column, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("image_path", "label", "cluster_id")
#: One field: quoted (quotes doubled inside, possibly never closed) or bare.
_FIELD = r'(?:"(?:[^"]++|"")*+(?:"|\z)[^,\r\n]*+|(?!")[^,\r\n]*+)'
_LINE = rf"{_FIELD}(?:,{_FIELD})*+"
_UNCLOSED = r'(?s)\A"(?:[^"]++|"")*+\z'


def _fields(line: Column) -> Column:
    return F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(rf",({_FIELD})"), 1)


def _unquoted(field: Column) -> Column:
    inner = F.replace(F.regexp_replace(field, r'(?s)\A"((?:[^"]++|"")*+)"([^,\r\n]*+)\z', "$1$2"), F.lit('""'), F.lit('"'))
    return F.when(field.startswith('"'), inner).otherwise(field)


def index_records(files: DataFrame, file_id: str = "file_id", content: str = "content", *carried: str) -> DataFrame:
    """One row per CSV record: ``(file_id, rec_no, image_path, label, cluster_id, *carried)``.

    A record is a line of exactly three fields; a first line that holds the three column names is the header and gives
    their order, else the order is image_path, label, cluster_id. Blank lines, lines with fewer or more fields and a
    last line inside an unclosed quote are no records. A leading byte order mark is dropped; line ends are LF, CR or
    CRLF; a quoted field may hold line ends. ``rec_no`` counts from 1 within the file. Null or empty content: no record.
    """
    text = F.regexp_replace(F.col(content), "^\uFEFF+", "")
    lines = F.filter(F.regexp_extract_all(text, F.lit(f"({_LINE})"), 1), lambda x: F.length(x) > 0)
    rows = F.transform(lines, _fields)
    rows = F.filter(rows, lambda r: (F.size(r) == 3) & ~F.exists(r, lambda f: f.rlike(_UNCLOSED)))
    rows = F.transform(rows, lambda r: F.transform(r, _unquoted))
    parsed = files.select(F.col(file_id).alias("file_id"), *carried, rows.alias("rows"))
    first = F.get(F.col("rows"), F.lit(0))  # a header can only be the first line
    is_header = F.coalesce(F.array_sort(first) == F.array(*map(F.lit, sorted(FIELDS))), F.lit(False))
    parsed = parsed.withColumn("order", F.when(is_header, first).otherwise(F.array(*map(F.lit, FIELDS)))).withColumn(
        "rows", F.when(is_header, F.slice("rows", 2, F.greatest(F.lit(0), F.size("rows") - 1))).otherwise(F.col("rows"))
    )
    each = parsed.select("file_id", *carried, "order", F.posexplode("rows").alias("pos", "row"))
    at = lambda name: F.element_at("row", F.array_position("order", F.lit(name)).cast("int"))
    return each.select("file_id", (F.col("pos") + 1).cast("long").alias("rec_no"), *[at(f).alias(f) for f in FIELDS], *carried)
