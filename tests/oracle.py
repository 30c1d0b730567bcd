"""Compares a query's rows with DuckDB's for its oracle."""

import math

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(value)


def rows_of(df: pd.DataFrame, columns: list[str]) -> list[tuple]:
    return sorted(tuple(plain(v) for v in row) for row in df[columns].astype(object).values.tolist())


def expected(sql: str, sf: str = SF) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con.sql(sql).df()


def assert_same(spark, query, sql: str, sf: str = SF) -> None:
    got, want = query(spark, sf).toPandas(), expected(sql, sf)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows_of(got, columns) == rows_of(want, columns)
