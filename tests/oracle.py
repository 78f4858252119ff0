"""Rows of a query and of its SQL, in a form that compares."""

import math
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    return v


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted(repr([plain(v) for v in r]) for r in df.select(*cols).collect())


def duck_rows(directory, sql):
    con = duckdb.connect()
    for p in os.listdir(directory):
        con.sql(f"CREATE VIEW {p[:-8]} AS SELECT * FROM read_parquet('{directory}/{p}')")
    rel = con.sql(sql)
    cols = sorted(rel.columns)
    return cols, sorted(repr([plain(v) for v in r]) for r in rel.select(*[f'"{c}"' for c in cols]).fetchall())
