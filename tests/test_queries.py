"""Every registered query with SQL gives the rows of that SQL on DuckDB."""

import os

import duckdb
import pytest

from tessella import queries
from tests.conftest import DATA

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = duck.sql(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    rows = lambda df: sorted(map(str, df[names].astype(object).values.tolist()))
    assert rows(got) == rows(want)


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["i", "v", "price"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
