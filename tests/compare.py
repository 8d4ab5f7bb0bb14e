"""Runs registered queries next to their SQL and compares the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(sf_dir, f"{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str(v)


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def difference(spark_df, relation) -> str:
    """Empty if both have the same columns and rows."""
    a, b = sorted(spark_df.columns), sorted(relation.columns)
    if a != b:
        return f"columns {a} and {b}"
    x, y = rows_of(spark_df.columns, spark_df.collect()), rows_of(relation.columns, relation.fetchall())
    if x == y:
        return ""
    left, right = set(x), set(y)
    only = [r for r in x if r not in right][:2], [r for r in y if r not in left][:2]
    return f"{len(x)} and {len(y)} rows; only in Spark {only[0]}; only in SQL {only[1]}"
