"""Spark against SQL, rows as sorted multisets."""

import decimal
import glob
import math
import os

import duckdb


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return int(v) if v == int(v) else float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


def same(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    key = lambda row: tuple((x is not None, str(type(x)), str(x)) for x in row)
    a = sorted((tuple(map(norm, r)) for r in df.select(*cols).collect()), key=key)
    b = sorted((tuple(map(norm, r)) for r in con.execute(f"select {', '.join(cols)} from ({sql})").fetchall()), key=key)
    assert a == b
