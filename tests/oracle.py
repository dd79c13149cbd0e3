"""Compares a query's rows with its SQL's on DuckDB, whatever their order."""

import math
import os

import duckdb


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.7g}"
    return str(v)


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())


def duck(sf: str, sql: str):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf}/{name}'")
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted(tuple(shown(r[i]) for i in order) for r in result.fetchall())
