"""Compare a Spark result with a SQL result, regardless of row and column order."""

from __future__ import annotations

import datetime as dt
import math
import pathlib
from collections import Counter
from decimal import Decimal

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(pathlib.Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def _plain(value):
    if isinstance(value, Decimal):
        value = int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else repr(round(value, 9))
    if isinstance(value, (dt.date, dt.datetime)):
        return value.isoformat()
    return value


def _bag(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def spark_bag(df):
    return _bag(df.columns, [tuple(row) for row in df.collect()])


def sql_bag(con, sql):
    con.execute(sql)
    return _bag([column[0] for column in con.description], con.fetchall())


def differences(df, con, sql, show=3) -> str:
    """Empty if both results hold the same columns and rows."""
    (got_names, got), (want_names, want) = spark_bag(df), sql_bag(con, sql)
    if got_names != want_names:
        return f"columns {got_names} against {want_names}"
    extra, missing = got - want, want - got
    if not extra and not missing:
        return ""
    return (
        f"{sum(got.values())} rows against {sum(want.values())}; "
        f"only in result: {list(extra)[:show]}; only in SQL: {list(missing)[:show]}"
    )
