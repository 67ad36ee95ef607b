"""Every named query against its SQL counterpart in DuckDB, on the same parquet tables."""

import math
import os

import duckdb
import pytest

from alertline.plans.oracles import ORACLES
from alertline.plans.queries import QUERIES

FOLDER = os.environ.get("ALERTLINE_TEST_FOLDER", "/root/testdata/sf0.01")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{FOLDER}/{name}.parquet')")
    return connection


def normal(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    table = [tuple(normal(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(table, key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    names, rows = sorted_rows(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = duck.execute(ORACLES[name])
    expected_names, expected = sorted_rows([c[0] for c in cursor.description], cursor.fetchall())
    assert names == expected_names
    assert len(rows) == len(expected)
    for got, want in zip(rows, expected):
        assert got == want
        assert [type(v) for v in got] == [type(v) for v in want]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).collect()
