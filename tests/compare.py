"""Rows of a query against rows of its SQL in DuckDB."""

import glob
import os

import duckdb
import pandas as pd


def _cell(x):
    if x is None or (not hasattr(x, "__len__") and pd.isna(x)):
        return "null"
    if isinstance(x, float) and x == int(x):
        return repr(int(x))
    return repr(x.item() if hasattr(x, "item") else x)


def rows(frame):
    cols = sorted(frame.columns)
    return sorted(tuple(map(_cell, r)) for r in frame[cols].astype(object).itertuples(index=False))


def oracle(sf_dir, sql):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con.execute(sql).df()


def check(spark, sf_dir, query, sql):
    got, want = query(spark, sf_dir).toPandas(), oracle(sf_dir, sql)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
