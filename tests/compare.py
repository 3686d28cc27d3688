"""Comparing a query's rows with those of its SQL."""

import math
import os

import duckdb


def connect(folder: str):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in os.listdir(folder):
        if t.endswith(".parquet"):
            c.sql(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{folder}/{t}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "<null>"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return round(float(v), 6)
    return str(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in values), key=repr)


def spark_rows(df):
    return sorted(df.columns), rows(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(c, sql):
    r = c.sql(sql)
    return sorted(r.columns), rows(list(r.columns), r.fetchall())
