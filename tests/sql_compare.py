"""Runs a query and its SQL over the same tables and compares the rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def told(value):
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    return str([told(v) for v in value]) if isinstance(value, list | tuple) else repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(told(r[i]) for i in order) for r in rows)


def compare(spark, folder, query, sql):
    """(rows of the query, rows of its SQL), each with columns by name and in order."""
    df = query(spark, folder)
    found = connect(folder).sql(sql)
    assert sorted(df.columns) == sorted(found.columns)
    return rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(found.columns, found.fetchall())
