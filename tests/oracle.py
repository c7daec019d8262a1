"""Comparing a registered query with its SQL."""

from __future__ import annotations

import duckdb

from textquarry.workload.views import TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in sorted(TABLES):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def compare(spark_df, con, sql: str) -> str | None:
    """``None`` when both give the same rows, else what differs."""
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    expected = rows_of(columns, cursor.fetchall())
    if sorted(columns) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(columns)}"
    got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if got == expected:
        return None
    extra = [r for r in got if r not in set(expected)][:3] if len(got) < 20000 else []
    missing = [r for r in expected if r not in set(got)][:3] if len(got) < 20000 else []
    return f"rows {len(got)} != {len(expected)}; only spark {extra}; only sql {missing}"
