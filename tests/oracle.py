"""Runs a query and its DuckDB SQL over the same Parquet files and compares rows."""

import math
import os
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def plain(v):
    if v is None:
        return "null"
    if isinstance(v, (float, Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.6g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)


def same(spark, folder, query, sql, con=None):
    df = query(spark, folder)
    names = sorted(df.columns)
    got = sorted(str([plain(x) for x in r]) for r in df.select(*names).collect())
    rel = (con or connect(folder)).sql(sql)
    assert sorted(rel.columns) == names
    at = [rel.columns.index(n) for n in names]
    want = sorted(str([plain(r[i]) for i in at]) for r in rel.fetchall())
    assert got == want
    return len(got)
