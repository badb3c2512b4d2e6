"""The registered queries of the training-data operators agree with their SQL, in DuckDB over the same tables."""

import os

import duckdb
import pytest

from geoweft.llm import oracles, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    a, b = queries.QUERIES[name](spark, SF).toPandas(), con.sql(oracles.ORACLES[name]).df()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    rows = lambda d: sorted(map(repr, d[columns].astype(object).where(d[columns].notna(), None).itertuples(index=False, name=None)))
    assert rows(a) == rows(b)
