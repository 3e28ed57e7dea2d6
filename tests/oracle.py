"""Runs SQL over the test tables and compares it with a DataFrame, rows in any order."""

import glob
import os
from datetime import datetime
from decimal import Decimal

import duckdb


def tables(sf_dir):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        source = path if os.path.isfile(path) else f"{path}/*.parquet"
        con.sql(f"create view {name} as select * from read_parquet('{source}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, Decimal):
        return int(value)
    if isinstance(value, datetime):
        return value.replace(tzinfo=None)
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def assert_same(df, con, sql):
    found = con.sql(sql)
    assert sorted(df.columns) == sorted(found.columns)
    assert rows(df.columns, df.collect()) == rows(found.columns, found.fetchall())
