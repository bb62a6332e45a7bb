"""Compares a query with its SQL in DuckDB, whatever the order of rows and columns."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (int, bool, type(None), str)):
        return x
    return str(x) if not hasattr(x, "as_tuple") else round(float(x), 6)


def same(df, sql, sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    r = c.execute(sql)
    names = [x[0] for x in r.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(n) for n in df.columns]
    theirs = sorted(repr([cell(row[i]) for i in order]) for row in r.fetchall())
    ours = sorted(repr([cell(x) for x in row]) for row in df.collect())
    assert ours == theirs
