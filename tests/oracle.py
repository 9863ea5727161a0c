"""Runs a query and its SQL over the same tables and compares the rows."""

from __future__ import annotations

import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def _plain(x):
    if isinstance(x, list):
        return tuple(_plain(y) for y in x)
    if isinstance(x, float):
        return round(x, 6)
    return x


def rows(names: list[str], found) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in found)


def difference(spark, con, query, sql: str, sf_dir: str) -> str:
    """Empty if both give the same rows."""
    df = query(spark, sf_dir)
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    theirs = rows(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    if ours != theirs:
        return f"{sum(ours.values())} and {sum(theirs.values())} rows; only here {list((ours - theirs).items())[:3]}; only in SQL {list((theirs - ours).items())[:3]}"
    return ""
