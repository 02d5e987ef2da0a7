"""Run a registered query on Spark and its SQL on DuckDB, and compare the two row multisets."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb

from tidepanel.registry import ORACLES, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{Path(folder) / name}.parquet'")
    return connection


def _multiset(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(repr(row[i]) for i in order) for row in rows)


def compare(spark, connection, folder: str, name: str) -> tuple[int, list[str]]:
    """``(row count, differences)``; no differences means equal columns and equal rows."""
    frame = QUERIES[name](spark, folder)
    rows = frame.collect()
    result = connection.execute(ORACLES[name])
    columns = [entry[0] for entry in result.description]
    expected = result.fetchall()
    if sorted(columns) != sorted(frame.columns):
        return len(rows), [f"columns {sorted(frame.columns)} but expected {sorted(columns)}"]
    ours, theirs = _multiset(frame.columns, rows), _multiset(columns, expected)
    problems = [f"only Spark: {row} x{n}" for row, n in list((ours - theirs).items())[:3]]
    problems += [f"only SQL: {row} x{n}" for row, n in list((theirs - ours).items())[:3]]
    if len(rows) != len(expected):
        problems.append(f"{len(rows)} rows but expected {len(expected)}")
    return len(rows), problems
