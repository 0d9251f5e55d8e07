"""Holds a query's rows against DuckDB's over the same files."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return db


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, bool) or value is None:
        return value
    return value if isinstance(value, (int, str)) else str(value)


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df: DataFrame, db: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs, empty if nothing does."""
    found = db.execute(sql)
    theirs_columns = [d[0] for d in found.description]
    theirs = rows_of(theirs_columns, found.fetchall())
    mine = rows_of(df.columns, df.collect())
    if sorted(df.columns) != sorted(theirs_columns):
        return [f"columns {sorted(df.columns)} and {sorted(theirs_columns)}"]
    if len(mine) != len(theirs):
        return [f"{len(mine)} and {len(theirs)} rows"]
    return [f"{a} and {b}" for a, b in zip(mine, theirs, strict=True) if a != b][:3]
