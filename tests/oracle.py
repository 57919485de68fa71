"""Compare named queries with their SQL oracles on the driver tables."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
from collections import Counter

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, int):
        return value
    if isinstance(value, decimal.Decimal):
        return ("decimal", str(value))
    if isinstance(value, (datetime.date, datetime.datetime)):
        return ("date", str(value))
    return ("other", str(value))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def compare(frame, con, sql):
    """``None`` when both sides give the same columns and rows, else what differs."""
    rows = frame.collect()
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(names)}"
    left, right = rows_of(frame.columns, rows), rows_of(names, result.fetchall())
    if left == right:
        return None
    order = sorted(frame.columns)
    only_left, only_right = list((left - right).items()), list((right - left).items())
    return (
        f"rows {sum(left.values())} / {sum(right.values())}; columns {order}\n  only spark ({len(only_left)}): "
        f"{sorted(only_left, key=str)[:3]}\n  only oracle ({len(only_right)}): {sorted(only_right, key=str)[:3]}"
    )
