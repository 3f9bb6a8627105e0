"""Every registered query against its reference SQL on the driver tables."""

import math
import os
from datetime import date, datetime

import duckdb
import pytest

import __spark_entry__ as entry_file
from tallyframe.workload.oracles import ORACLES
from tallyframe.workload.queries import ALL_QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF_DIR}/{table}.parquet')"
        )
    return connection


def comparable(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (int, float)):
        return "NaN" if math.isnan(value) else repr(float(value))
    if isinstance(value, (date, datetime)):
        return value.isoformat()
    return str(value)


def as_multiset(columns, rows):
    order = sorted(range(len(columns)), key=lambda position: columns[position])
    return sorted(tuple(comparable(row[position]) for position in order) for row in rows)


def test_same_names():
    assert set(ALL_QUERIES) == set(ORACLES)
    assert set(ORACLES) <= set(entry_file.oracle_sql()) and set(ALL_QUERIES) <= set(entry_file.queries())


def test_entry_runs(spark):
    assert entry_file.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ALL_QUERIES))
def test_query_equals_oracle(spark, duck, name):
    found = entry_file.queries()[name](spark, SF_DIR)
    rows = [tuple(row) for row in found.collect()]
    expected = duck.execute(entry_file.oracle_sql()[name])
    names = [column[0] for column in expected.description]
    assert sorted(found.columns) == sorted(names)
    assert as_multiset(found.columns, rows) == as_multiset(names, expected.fetchall())
