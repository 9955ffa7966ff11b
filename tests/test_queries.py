"""Every registered query of the engine against its SQL in DuckDB."""

import math

import duckdb
import pytest

from kerbside.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    rel = duck.sql(catalogue.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    key = lambda r: tuple((x is None, str(type(x)), x) for x in r)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=key)
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=key)
    assert got == want
    assert got


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() >= 0
