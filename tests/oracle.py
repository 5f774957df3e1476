"""Compares a query with its SQL on the same tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def rows_of(columns, rows):
    return sorted(tuple(repr(v) for _, v in sorted(zip(columns, r))) for r in rows)


def same(df, con, sql):
    made = con.sql(sql)
    assert sorted(df.columns) == sorted(made.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(made.columns, made.fetchall())
