"""Every registered query against its oracle on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import check
import registry
from foliant.sources.fixtures import SOURCE_TABLES

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in SOURCE_TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    result = check.compare(spark, db, FOLDER, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert result[0] in ("ok", "rows-only"), result


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
