"""Holding a query's rows against those of its oracle SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    """DuckDB with the tables of a data folder as views."""
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        source = f"{path}/*.parquet" if path.is_dir() else str(path)
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{source}')")
    return db


def plain(value):
    """A value as both sides give it."""
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value.asDict().values())
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    return value


def rows_of(names, rows):
    """Rows as tuples in the order of the column names, sorted."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def check(spark, sf_dir: str, build, sql: str) -> int:
    """Assert that both give the same columns and rows; returns the number of rows."""
    frame = build(spark, sf_dir)
    ours = rows_of(frame.columns, frame.collect())
    result = connect(sf_dir).execute(sql)
    names = [d[0] for d in result.description]
    theirs = rows_of(names, result.fetchall())
    assert sorted(frame.columns) == sorted(names)
    assert len(ours) == len(theirs)
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    assert not wrong, f"{len(wrong)} of {len(ours)} rows differ, first {wrong[0]}"
    return len(ours)
