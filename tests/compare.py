"""Side-by-side run of a registered query and its SQL, row by row."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return ("float", "nan" if math.isnan(value) else value + 0.0)
    if isinstance(value, bool):
        return ("bool", value)
    if isinstance(value, int):
        return ("int", value)
    if isinstance(value, decimal.Decimal):
        return ("decimal", value)
    if isinstance(value, datetime.datetime):
        return ("ts", value.replace(tzinfo=None))
    return value


def _bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(df, con, sql) -> str | None:
    """None if equal, else what differs first."""
    spark_rows = [tuple(r) for r in df.collect()]
    found = con.execute(sql)
    sql_columns = [d[0] for d in found.description]
    if sorted(sql_columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(sql_columns)}"
    sql_rows = found.fetchall()
    if len(spark_rows) != len(sql_rows):
        return f"rows {len(spark_rows)} != {len(sql_rows)}"
    ours, theirs = _bag(df.columns, spark_rows), _bag(sql_columns, sql_rows)
    if ours == theirs:
        return None
    only, missing = ours - theirs, theirs - ours
    return (
        f"{sorted(df.columns)}: {sum(only.values())} rows differ\n"
        f"  spark {str(next(iter(only)))[:400]}\n  sql   {str(next(iter(missing)))[:400]}"
    )
