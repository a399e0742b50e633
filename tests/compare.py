"""Compare a query's rows with DuckDB's, regardless of order."""

import glob
import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def _value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), Counter(tuple(_value(r[k]) for k in order) for r in rows)


def compare(df, con, sql):
    got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert got[0] == want[0], (got[0], want[0])
    missing, extra = want[1] - got[1], got[1] - want[1]
    assert not missing and not extra, f"{sum(want[1].values())} wanted, {sum(got[1].values())} got; missing {list(missing)[:3]}, extra {list(extra)[:3]}"
