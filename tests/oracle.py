"""A query against its SQL twin in DuckDB, insensitive to order."""

import datetime
import glob
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(x):
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 6) + 0.0)
    if isinstance(x, int) or hasattr(x, "as_tuple"):
        return repr(round(float(x), 6) + 0.0)
    if isinstance(x, (list, tuple)):
        return str([plain(y) for y in x])
    return x.isoformat() if isinstance(x, datetime.datetime) else str(x)


def differences(df, con, sql):
    """(columns differ, rows only here, rows only there)."""
    columns = sorted(df.columns)
    mine = sorted([plain(r[c]) for c in columns] for r in df.collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != columns:
        return columns, names
    at = [names.index(c) for c in columns]
    theirs = sorted([plain(r[i]) for i in at] for r in result.fetchall())
    if mine == theirs:
        return None
    return [x for x in mine if x not in theirs][:3], [x for x in theirs if x not in mine][:3]
