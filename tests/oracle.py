"""Spark's rows against DuckDB's rows of the equivalent SQL."""

import glob
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows(df):
    cols = sorted(df.columns)
    plain = df[cols].astype(object).where(df[cols].notna(), None)
    return sorted(map(repr, plain.itertuples(index=False, name=None)))


def same(spark_df, con, sql):
    a, b = spark_df.toPandas(), con.sql(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)
