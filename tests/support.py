"""Compare frames as sorted rows of text, numbers rounded, columns by name."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd


def cell(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(cell, v)) + "]"
    if v is None or pd.isna(v):
        return "~"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (str, pd.Timestamp)):
        return str(v)
    return repr(round(float(v), 5))


def lines(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return list(frame.columns), sorted("|".join(map(cell, r)) for r in frame.itertuples(index=False, name=None))


def rows_of_spark(df):
    return lines(df.toPandas())


def rows_of_duckdb(sf_dir, sql):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return lines(con.sql(sql).df())
