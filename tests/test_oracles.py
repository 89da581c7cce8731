"""Every registered query against its SQL twin in another engine."""

import duckdb
import pytest

import __spark_entry__ as entry
from concord.suite.oracles import oracles
from concord.suite.queries import QUERIES

DIR = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(oracles())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, database, name):
    df = QUERIES[name](spark, DIR)
    names = sorted(df.columns)
    found = sorted(repr(tuple(r[c] for c in names)) for r in df.collect())
    cursor = database.execute(oracles()[name])
    order = [[d[0] for d in cursor.description].index(c) for c in names]
    expected = sorted(repr(tuple(r[i] for i in order)) for r in cursor.fetchall())
    assert len(order) == len(names) and found == expected


def test_entry(spark):
    found = {r.category for r in entry.entry(spark).collect()}
    assert "matching" in found and len(found) == 5
