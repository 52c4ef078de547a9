"""Compares a query with its DuckDB equivalent."""

import glob
import math
import os

import duckdb


def connect(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        path = f"{f}/*" if os.path.isdir(f) else f
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    return str(v)


def rows(columns, values):
    names = sorted(columns)
    at = [list(columns).index(n) for n in names]
    return names, sorted(tuple(plain(r[i]) for i in at) for r in values)


def compare(spark, sf, name, query, sql):
    df = query(spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = connect(sf).execute(sql)
    want = rows([d[0] for d in cur.description], cur.fetchall())
    assert got == want, name
