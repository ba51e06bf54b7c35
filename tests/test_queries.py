"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from ribospark.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def values(rows):
    return sorted(tuple("~" if x is None else f"{x:.6f}" if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(set(catalog.oracle_sql()) - {"train_k8", "classify_k8"}))
def test_query_matches_its_sql(spark, sql, name):
    df = catalog.queries()[name](spark, SF)
    want = sql.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    assert values(df.select(order).collect()) == values(want.select(*[f'"{c}"' for c in order]).fetchall())
    spark.catalog.clearCache()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 200
