"""Compare a query's rows with DuckDB's on the same tables."""

import datetime
import decimal
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return v


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted(repr([plain(r[c]) for c in names]) for r in df.collect())


def duck(sf_dir, sql):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    r = c.sql(sql)
    names = sorted(r.columns)
    at = [r.columns.index(n) for n in names]
    return names, sorted(repr([plain(x[i]) for i in at]) for x in r.fetchall())
