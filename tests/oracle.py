"""Comparison of a Spark result with DuckDB's on the same tables."""

import math
from pathlib import Path

import duckdb

SMALL = "/root/testdata/sf0.001"


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def text(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else repr(round(x, 6) + 0.0)
        return str(x)

    return [columns[k] for k in order], sorted(tuple(text(r[k]) for k in order) for r in rows)


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def same(df, con, sql):
    expected = con.sql(sql)
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(expected.fetchall(), expected.columns)
