"""Every registered query against the same query in SQL, over whole tables."""

import os

import duckdb
import pytest

import __spark_entry__ as driver

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = ("nation", "customer", "orders", "lineitem", "documents")


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(row[i] for i in order) for row in values), key=repr)


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'"
        )
    return connection


OWN = sorted(driver.queries().keys() - (driver.llm.queries().keys() if driver.llm else ()))


def test_every_query_has_an_oracle():
    assert set(OWN) <= driver.oracle_sql().keys() <= driver.queries().keys()


@pytest.mark.parametrize("key", OWN)
def test_query_equals_oracle(spark, oracle, key):
    result = driver.queries()[key](spark, SF_DIR)
    cursor = oracle.execute(driver.oracle_sql()[key])
    names = [column[0] for column in cursor.description]
    assert sorted(result.columns) == sorted(names)
    expected = rows(names, cursor.fetchall())
    assert expected
    assert rows(result.columns, result.collect()) == expected


def test_entry(spark):
    assert driver.entry(spark).count() == 1992
