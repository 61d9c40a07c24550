"""Runs catalogue queries beside their SQL."""

import glob
import math
import os

import duckdb
import pandas as pd


def connect(folder):
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def _value(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if hasattr(v, "item"):
        v = v.item() if getattr(v, "ndim", 0) == 0 else list(v)
    return repr(round(float(v), 6)) if isinstance(v, float) else str(v)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(_value, r)) for r in frame[columns].itertuples(index=False))


def assert_same(spark_frame, sql, con):
    assert rows(spark_frame.toPandas()) == rows(con.execute(sql).df())
