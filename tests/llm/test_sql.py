"""The queries that SQL can express against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from ribospark.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, want = queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    show = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert show(df.select(order).collect()) == show(want.select(*order).fetchall())
