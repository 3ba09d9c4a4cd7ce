"""Compares registered queries with their SQL in DuckDB."""

import glob
import os

import duckdb


def normal(v):
    s = str(v)
    if s in ("nan", "<NA>", "None", "NaT"):
        return "NULL"
    return s[:-2] if s.endswith(".0") and s[:-2].lstrip("-").isdigit() else s


def rows(frame, columns):
    return sorted(tuple(map(normal, r)) for r in frame[columns].astype(object).itertuples(index=False))


def compare(spark, query, sql, sf_dir):
    got = query(spark, sf_dir).toPandas()
    con = duckdb.connect()
    for p in glob.glob(sf_dir + "/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)
