"""Comparing a query with its SQL twin, rows in any order, columns by name."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 8))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


def rows_of(columns, rows):
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    return order, sorted(tuple(norm(r[i]) for i in at) for r in rows)


def check(df, con, sql):
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    r = con.execute(sql)
    want = rows_of([d[0] for d in r.description], r.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
