"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tokenloom.plans import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return con


def test_every_query_has_sql():
    # The vocabulary of these is beyond chained SQL: test_tokens replays it.
    assert set(QUERIES) - set(entry.oracle_sql()) == {
        "bpe_train_large", "bpe_encode_large", "bpe_train_full", "vocabulary_full", "bpe_encode_full"}


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", [n for n in QUERIES if n in entry.oracle_sql()])
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    result = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == cols
    want = sorted(repr(tuple(row[names.index(c)] for c in cols)) for row in result.fetchall())
    assert sorted(repr(tuple(r)) for r in df.select(*cols).collect()) == want
