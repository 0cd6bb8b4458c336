"""Spark results against DuckDB's on the same tables."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _plain(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    if isinstance(value, float) and value == int(value):
        return int(value)
    return value.item() if hasattr(value, "item") else (str(value)[:10] if hasattr(value, "year") else value)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(map(_plain, r)) for r in frame[columns].itertuples(index=False)), key=str)
