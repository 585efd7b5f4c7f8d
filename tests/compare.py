"""Rows of a Spark query against those of SQL in DuckDB."""

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda x: None if x is None else (tuple(x) if isinstance(x, list | np.ndarray) else x)).astype(str)
        elif str(df[c].dtype).lower().startswith(("float", "int", "uint", "bool")):
            df[c] = df[c].astype(float)
        else:
            df[c] = df[c].astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def assert_same(spark_df, sql_df):
    a, b = plain(spark_df.toPandas()), plain(sql_df)
    pd.testing.assert_frame_equal(a, b, check_dtype=False, check_exact=False, rtol=0, atol=1e-9)
