"""Comparison of a query with its SQL, as rows of values without order."""

import math

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value if value is None or isinstance(value, (bool, int, str)) else str(value)


def rows(spark, name, function, statement, sf_dir):
    got = function(spark, sf_dir)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(statement)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns), (name, columns, want.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    left = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=key)
    at = [want.columns.index(c) for c in columns]
    right = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=key)
    return left, right
