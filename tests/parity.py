"""Rows of a query and of its SQL in DuckDB, in comparable form."""

import glob
import math
import os

import duckdb
import pandas as pd


def connect(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    if isinstance(v, list | tuple):
        return str([norm(x) for x in v])
    if isinstance(v, bytes | bytearray):
        return bytes(v).hex()
    return str(v)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(norm(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())


def duck_rows(con, sql):
    rel = con.sql(sql)
    at = [rel.columns.index(c) for c in sorted(rel.columns)]
    return sorted(rel.columns), sorted(tuple(norm(r[i]) for i in at) for r in rel.fetchall())
