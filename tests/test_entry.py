"""The driver's contract: queries agree with their SQL, in DuckDB over the same tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from geoweft.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_agrees_with_sql(spark, con, name):
    a, b = catalog.QUERIES[name](spark, SF).toPandas(), con.sql(catalog.ORACLES[name]).df()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    rows = lambda d: sorted(map(repr, d[columns].astype(object).where(d[columns].notna(), None).itertuples(index=False, name=None)))
    assert rows(a) == rows(b)


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
