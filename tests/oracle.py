"""Compares a query with its SQL on DuckDB."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"



def by_sql(sql, sf_dir=SMALL):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c.sql(sql).df()


def key(r):
    return tuple(str(x) for x in r)


def assert_same(df, sql, sf_dir=SMALL):
    import pandas as pd

    a, b = df.toPandas(), by_sql(sql, sf_dir)
    assert sorted(a.columns) == sorted(b.columns)
    f = lambda x: sorted((key(None if pd.isna(v) else v for v in r) for r in x[sorted(x.columns)].astype(object).itertuples(index=False, name=None)))
    assert f(a) == f(b)
