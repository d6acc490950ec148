"""Side-by-side comparison of a registered query and its reference SQL."""

from __future__ import annotations

import math
from datetime import date, datetime
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES.split():
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return connection


def plain(value):
    """One form per value, whatever engine it comes from."""
    if isinstance(value, datetime):
        return value.date() if value.time().isoformat() == "00:00:00" else value
    if isinstance(value, (bool, date, str)) or value is None:
        return value
    if isinstance(value, (int, float, Decimal)):
        number = float(value)
        return "nan" if math.isnan(number) else number
    return str(value)


def rows_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    """Columns by name and rows in a fixed order."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    table = [tuple(plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(table, key=repr)


def compare(df, connection: duckdb.DuckDBPyConnection, sql: str) -> int:
    """Asserts equality of columns and of all values; returns the number of rows."""
    ours = rows_of(df.columns, df.collect())
    cursor = connection.execute(sql)
    theirs = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert ours[0] == theirs[0], (ours[0], theirs[0])
    assert len(ours[1]) == len(theirs[1]), (len(ours[1]), len(theirs[1]))
    for a, b in zip(ours[1], theirs[1]):
        assert a == b, (a, b)
    return len(ours[1])
