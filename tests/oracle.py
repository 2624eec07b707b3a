"""Runs a query and its SQL on the same tables and compares columns, types and values."""

import datetime
import glob
import math
import os
from decimal import Decimal

import duckdb


def connect(folder):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{source}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, Decimal):
        return round(float(value), 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, list | tuple):
        return tuple(map(plain, value))
    return value


def rows(columns, values):
    return sorted((tuple(plain(v) for v in row) for row in values), key=lambda r: tuple((v is None, str(v)) for v in r)), columns


TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}


def compare(df, con, sql):
    columns = sorted(df.columns)
    result = con.execute(sql)
    names, kinds = [c[0] for c in result.description], {c[0]: str(c[1]) for c in result.description}
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = rows(columns, ([row[k] for k in at] for row in result.fetchall()))
    got = rows(columns, ([row[c] for c in columns] for row in df.collect()))
    assert got == want
    types = dict(df.dtypes)
    assert {c: TYPES[kinds[c]] for c in columns if kinds[c] in TYPES} == {c: types[c] for c in columns if kinds[c] in TYPES}
