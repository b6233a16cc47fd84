"""Runs registered queries and their DuckDB SQL on the same tables and compares the rows."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FOLDER = "/root/testdata/sf0.001"


def _plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(_plain, v)) if isinstance(v, (list, tuple)) else v


def rows_of(spark, query, folder=FOLDER):
    df = query(spark, folder)
    columns = sorted(df.columns)
    return columns, sorted(repr([_plain(r[c]) for c in columns]) for r in df.collect())


def rows_by_sql(sql, folder=FOLDER):
    db = duckdb.connect()
    db.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    found = db.sql(sql)
    columns = sorted(found.columns)
    place = [found.columns.index(c) for c in columns]
    return columns, sorted(repr([_plain(r[i]) for i in place]) for r in found.fetchall())
