"""Rows of a Spark query against rows of its SQL."""

import datetime
import glob
import math
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return v.isoformat() if isinstance(v, datetime.datetime) else v


def both(spark, query, sql, folder):
    c = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = query(spark, folder)
    cols = sorted(df.columns)
    cur = c.execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    want = [tuple(plain(r[names.index(x)]) for x in cols) for r in cur.fetchall()]
    got = [tuple(plain(r[x]) for x in cols) for r in df.collect()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    return sorted(got, key=key), sorted(want, key=key)
