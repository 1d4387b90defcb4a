"""Comparison of a query with its SQL on one data folder."""

import os

import duckdb


def same(spark, name, run, sql, folder):
    connection = duckdb.connect()
    connection.execute("SET timezone = 'UTC'")
    for f in os.listdir(folder):
        connection.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{folder}/{f}'")
    df = run(spark, folder)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    answer = connection.sql(sql)
    at = [answer.columns.index(c) for c in columns]
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in answer.fetchall())
