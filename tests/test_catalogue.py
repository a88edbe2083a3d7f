import math

import duckdb
import pandas as pd
import pytest

from gatefold import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def cell(v):
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    return int(v) if isinstance(v, float) and v == int(v) else v.item() if hasattr(v, "item") else v


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(str(tuple(map(cell, r))) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    ours, theirs = catalogue.QUERIES[name](spark, SF).toPandas(), duck.sql(catalogue.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_every_other_query_runs(spark):
    for name in set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL):
        assert catalogue.QUERIES[name](spark, SF).count() > 0
