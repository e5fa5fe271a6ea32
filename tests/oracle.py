"""Comparison of a query's rows with DuckDB's."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or isinstance(v, float) and v != v:
            return "null"
        if isinstance(v, float):
            return str(round(v, 6))
        return str(list(v)) if hasattr(v, "__len__") and not isinstance(v, (str, bytes)) else str(v)

    df = df.reindex(sorted(df.columns), axis=1)
    return sorted(tuple(map(plain, r)) for r in df.itertuples(index=False))
