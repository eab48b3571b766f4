"""Compare a registered query with its check SQL over the same parquet files."""

from __future__ import annotations

import datetime
import decimal

import duckdb

from tidewater.session import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def difference(spark_df, con, sql: str, show: int = 3) -> str | None:
    """None when both sides agree, else a short description."""
    ours = normal(spark_df.columns, [tuple(row) for row in spark_df.collect()])
    cursor = con.execute(sql)
    theirs = normal([c[0] for c in cursor.description], cursor.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} != {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"{len(ours[1])} rows != {len(theirs[1])} rows\n  {ours[1][:show]}\n  {theirs[1][:show]}"
    wrong = [(a, b) for a, b in zip(ours[1], theirs[1]) if repr(a) != repr(b)]
    if wrong:
        cells = [[(n, x, y) for n, x, y in zip(ours[0], a, b) if repr(x) != repr(y)] for a, b in wrong[:show]]
        return f"{len(wrong)} of {len(ours[1])} rows differ: {cells}"
    return None
