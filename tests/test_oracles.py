"""Every query with a SQL twin, on the smallest test data."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry

from .oracle import compare, database

FOLDER = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return database(FOLDER)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test data is not here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    assert compare(entry.queries()[name](spark, FOLDER), duck, ORACLES[name]) == []


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_each_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())
