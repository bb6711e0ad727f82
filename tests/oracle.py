"""Compares queries with their SQL on DuckDB, as multisets of rows."""

import datetime
import decimal
import glob
import os
from collections import Counter

import duckdb

DATA = "/root/testdata/sf0.001"


def connection(folder=DATA):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def same(df, con, sql):
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    rows = cursor.fetchall()
    assert sorted(df.columns) == sorted(names)
    want = Counter(tuple(plain(r[names.index(c)]) for c in df.columns) for r in rows)
    got = Counter(tuple(map(plain, r)) for r in df.collect())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
