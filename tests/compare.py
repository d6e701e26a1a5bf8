"""Compare Spark results with the SQL each query is checked against."""

from __future__ import annotations

import datetime
import decimal
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str):
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for name in TABLES:
        path = Path(folder) / f"{name}.parquet"
        if path.exists():
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if value != value else (int(value) if value == int(value) and abs(value) < 1e15 else value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if hasattr(value, "tolist"):
        return _plain(value.tolist())
    return value


def _rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(repr(_plain(r[i])) for i in order) for r in records]
    return sorted(columns), sorted(rows)


def differences(frame, connection, sql: str) -> str | None:
    """None when both sides agree, else a short description."""
    spark_columns, spark_rows = _rows(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = connection.execute(sql)
    columns = [d[0] for d in cursor.description]
    sql_columns, sql_rows = _rows(columns, cursor.fetchall())
    if spark_columns != sql_columns:
        return f"columns {spark_columns} != {sql_columns}"
    if len(spark_rows) != len(sql_rows):
        return f"{len(spark_rows)} rows != {len(sql_rows)}"
    for left, right in zip(spark_rows, sql_rows):
        if left != right:
            return f"{left} != {right}"
    if not spark_rows:
        return "no rows on either side"
    return None
