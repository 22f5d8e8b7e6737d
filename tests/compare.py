"""Compare a registered query with its SQL on the same Parquet tables."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(os.path.join(folder, "*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return round(value, 6) + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def kind(value) -> str:
    return {bool: "bool", int: "int", float: "float", str: "str"}.get(type(value), type(value).__name__)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    out.sort(key=lambda r: tuple((v is not None, str(v)) for v in r))
    return [columns[i] for i in order], out


def differences(spark, con, query, sql, folder) -> str | None:
    """None when both give the same columns, kinds and values, else what differs."""
    frame = query(spark, folder)
    spark_names, spark_rows = normal(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = con.execute(sql)
    sql_names, sql_rows = normal([d[0] for d in cursor.description], cursor.fetchall())
    if spark_names != sql_names:
        return f"columns {spark_names} != {sql_names}"
    if len(spark_rows) != len(sql_rows):
        return f"rows {len(spark_rows)} != {len(sql_rows)}: {spark_rows[:2]} / {sql_rows[:2]}"
    for a, b in zip(spark_rows, sql_rows):
        if a != b or [kind(x) for x in a if x is not None] != [kind(x) for x in b if x is not None]:
            return f"row {[(n, x, y) for n, x, y in zip(spark_names, a, b) if x != y or kind(x) != kind(y)]}"
    return None if spark_rows else "EMPTY"
