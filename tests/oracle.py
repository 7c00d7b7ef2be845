"""Runs a query's SQL in DuckDB and compares rows, whatever their order."""

import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sql: str, sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    found = con.sql(sql)
    return found.columns, found.fetchall()


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (int, str)):
        return x
    return str(x)


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(str(plain(r[i])) if not isinstance(plain(r[i]), (int, float)) else f"{float(plain(r[i])):.6f}" for i in order) for r in rows])


def same(df, sql: str, sf_dir: str) -> None:
    columns, expected = duck(sql, sf_dir)
    assert sorted(df.columns) == sorted(columns)
    got = bag(df.columns, [tuple(r) for r in df.collect()])
    assert got == bag(columns, expected)
