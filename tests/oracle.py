"""Rows of both engines in one canonical form."""

import datetime
import decimal
import glob
import math
import os

import duckdb


def connect(folder):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(float(f"{v:.9g}"))
    if isinstance(v, decimal.Decimal):
        return str(v)
    if isinstance(v, (list, tuple)):
        return str([canon(x) for x in v])
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows(table):
    return sorted([canon(r[c]) for c in sorted(table.column_names)] for r in table.to_pylist())


def from_spark(df):
    return rows(df.toArrow())


def from_duckdb(con, sql):
    out = con.execute(sql)
    return rows(out.to_arrow_table() if hasattr(out, "to_arrow_table") else out.fetch_arrow_table())
