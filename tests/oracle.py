"""Runs a query and its SQL twin and compares columns and rows, order aside."""

import glob
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def shown(x):
    return "[" + ",".join(map(shown, x)) + "]" if isinstance(x, list) else repr(x)


def assert_same(df, con, sql):
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    columns = sorted(df.columns)
    assert columns == sorted(names)
    want = sorted(tuple(shown(r[names.index(c)]) for c in columns) for r in found.fetchall())
    got = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    assert got == want
