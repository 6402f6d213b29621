"""Every registered query that has SQL, compared with it on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as contract
from tools.check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
QUERIES, SQL = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return connection


def test_every_check_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


def test_flagship(spark):
    assert contract.entry(spark).columns == ["i", "j", "value"]


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    cursor = db.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, got) == rows_of(names, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_gives_rows(spark, name):
    assert not QUERIES[name](spark, SF).isEmpty()
