"""Row-for-row comparison of a query with its check SQL."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    return value


def _rows(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def difference(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty when both sides hold the same rows of the same types, else what differs."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    theirs = cursor.fetchall()
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    for field in df.schema:
        name = field.dataType.simpleString()
        want = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}.get(name)
        if want is None or kinds[field.name] not in (want, {"BIGINT": "NUMBER", "DOUBLE": "NUMBER",
                                                           "VARCHAR": "STRING", "BOOLEAN": "bool"}[want]):
            return f"type of {field.name}: {name} against {kinds[field.name]}"
    left, right = _rows(df.columns, df.collect()), _rows(names, theirs)
    if left == right:
        return ""
    only_left, only_right = left - right, right - left
    return (
        f"{sum(left.values())} against {sum(right.values())} rows; only here "
        f"{list(only_left.items())[:2]}; only there {list(only_right.items())[:2]}"
    )
