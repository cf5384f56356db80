"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from quarrylight.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        table = name.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{name}'")
    return con


def plain(df):
    def text(x):
        if pd.isna(x):
            return "null"
        if isinstance(x, bool):
            return str(x)
        try:
            return f"{float(x):.6f}"
        except (TypeError, ValueError):
            return str(x)

    df = df[sorted(df.columns)]
    return sorted(tuple(text(x) for x in row) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_matches_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    want = db.execute(catalog.ORACLE[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
