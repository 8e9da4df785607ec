"""Runs queries beside their SQL."""

from collections import Counter
from pathlib import Path

import duckdb

DATA = "/root/testdata/sf0.001"


def _plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 9) + 0.0
    return bytes(v) if isinstance(v, bytearray) else v


def both(spark, query, sql, data=DATA):
    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    df = query(spark, data)
    cols = sorted(df.columns)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = Counter(tuple(_plain(r[names.index(c)]) for c in cols) for r in found.fetchall())
    got = Counter(tuple(_plain(r[c]) for c in cols) for r in df.collect())
    return got, want
