"""Holds a Spark result against DuckDB over the same files."""

import os

import duckdb
import pandas as pd

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def norm(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    out = [tuple(None if (not isinstance(v, (list, tuple)) and pd.isna(v)) else round(float(v), 6) if isinstance(v, float) else v.isoformat() if hasattr(v, "isoformat") else v.item() if hasattr(v, "item") else v for v in row) for row in df.itertuples(index=False)]
    return sorted(out, key=repr)


def duck(sql: str, sf: str = SF) -> pd.DataFrame:
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con.execute(sql).df()


def same(spark_df, sql: str, sf: str = SF) -> None:
    got, want = spark_df.toPandas(), duck(sql, sf)
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert norm(got) == norm(want)
