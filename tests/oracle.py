"""Runs a query and its SQL on the same tables and compares the rows."""

import datetime as dt
import glob
import math
import os

import duckdb

DATA = os.environ.get("FOLIOFORGE_TEST_DATA", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def connection(directory):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{directory}/*.parquet"):
        files = path if os.path.isfile(path) else f"{path}/*.parquet"
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{files}'")
    return con


def assert_same(spark, plan, sql, con, directory=DATA):
    df = plan(spark, directory)
    names = sorted(df.columns)
    rows = sorted((tuple(plain(v) for v in r) for r in df.select(*[df[n] for n in names]).collect()), key=repr)
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(columns) == names
    expected = sorted((tuple(plain(r[columns.index(n)]) for n in names) for r in found.fetchall()), key=repr)
    assert rows == expected
