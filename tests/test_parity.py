"""Every registered query against its SQL, on the smallest driver tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from itemloom.plans import catalog, oracle

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '/root/testdata/sf0.001/{name}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(oracle.statements())
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, sf_dir, database, name):
    cursor = database.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    expected = sorted(repr([row[i] for i in order]) for row in cursor.fetchall())
    df = entry.queries()[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(columns)
    got = sorted(repr([row[c] for c in sorted(df.columns)]) for row in df.collect())
    assert got == expected


def test_entry(spark):
    assert entry.entry(spark).count() > 0
