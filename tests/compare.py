"""Compares a query with its SQL, by column name and as bags of rows."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def bag(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = [None if pd.api.types.is_scalar(v) and pd.isna(v) else round(float(v), 6) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in df[c].astype(object)]
    return sorted(map(str, df.itertuples(index=False, name=None)))


def oracle(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con.execute(sql).df()


def assert_same(got, sql, sf_dir):
    want = oracle(sql, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    assert bag(got) == bag(want)
