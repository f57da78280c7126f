"""Rows of a DataFrame against rows of DuckDB's SQL over the same tables."""

import math

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def _value(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return None
    x = x.item() if hasattr(x, "item") else x
    if isinstance(x, float):
        return round(x, 5)
    if hasattr(x, "isoformat"):
        return pd.Timestamp(x).isoformat()
    return x


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(_value, r)) for r in frame.itertuples(index=False)), key=str)
