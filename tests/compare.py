"""Order-free comparison of a Spark result with DuckDB's."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool) or type(v).__name__ in ("bool_", "bool"):
        return str(bool(v))
    if hasattr(v, "__float__") and not isinstance(v, str):
        return f"{float(v):.6f}".replace("-0.000000", "0.000000")
    return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(cell(v) for v in r) for r in df.itertuples(index=False))


def same(spark_df, con, sql):
    a, b = spark_df.toPandas(), con.sql(sql).fetchdf()
    assert sorted(a.columns) == sorted(b.columns)
    x, y = rows(a), rows(b)
    assert len(x) == len(y)
    assert x == y
