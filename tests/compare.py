"""Compares a query with its SQL on the driver's tables."""

import datetime
import decimal
import math
import os

import duckdb

SF = "/root/testdata/sf0.01"


def connection(sf=SF):
    c = duckdb.connect()
    for f in os.listdir(sf):
        name = f.removesuffix(".parquet")
        c.sql(f"create view {name} as select * from '{sf}/{f}'" if os.path.isfile(f"{sf}/{f}") else f"create view {name} as select * from '{sf}/{f}/*.parquet'")
    return c


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return "NaN" if math.isnan(x) else (int(x) if x.is_integer() else repr(x))
    if isinstance(x, (datetime.date, datetime.datetime)):
        return x.isoformat()
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in data]
    return [columns[i] for i in order], sorted(out, key=repr)


def difference(spark, query, sql, sf=SF, connect=connection):
    """None if equal, else what differs."""
    df = query(spark, sf)
    names, got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = connect(sf).sql(sql)
    want_names, want = rows(rel.columns, rel.fetchall())
    if names != want_names:
        return f"columns {names} and {want_names}"
    if not want:
        return "no rows"
    if got != want:
        bad = [(a, b) for a, b in zip(got, want) if a != b][:3]
        return f"{len(got)} and {len(want)} rows; {bad}"
    return None
