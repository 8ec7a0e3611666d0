"""Compares a Spark query with its SQL in DuckDB, rows in any order."""

import math
import os

import duckdb


def tables(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return con


def value(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda n: columns[n])
    return sorted(tuple(value(r[n]) for n in order) for r in data)


def same(spark_df, con, sql):
    got = spark_df.collect()
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    assert sorted(spark_df.columns) == sorted(names)
    assert rows(spark_df.columns, got) == rows(names, want.fetchall())
