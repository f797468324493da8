"""Every registered query against its SQL."""
import os

import duckdb
import pytest

import __spark_entry__ as entry
from opslens.plans.queries import QUERIES, SQL

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def in_order(rows, at):
    return sorted((tuple(row[i] for i in at) for row in rows), key=repr)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL) and QUERIES.items() <= entry.queries().items() and SQL.items() <= entry.oracle_sql().items()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF_DIR)
    result = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    types = {c[0]: str(c[1]) for c in result.description}
    assert sorted(df.columns) == sorted(columns)
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema.fields} == types
    by_name = lambda names: sorted(range(len(names)), key=lambda i: names[i])
    assert in_order(df.collect(), by_name(df.columns)) == in_order(result.fetchall(), by_name(columns))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
