"""Every registered query of the engine against its SQL."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from tmengine.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def cells(df):
    def one(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
            return ""
        return str(int(x)) if isinstance(x, float) and x == int(x) else str(x)

    return sorted(tuple(one(x) for x in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    want = duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert cells(got) == cells(want)
