"""Every registered query against its SQL, on the small tables."""

import os

import pytest

import __spark_entry__ as entry
from compare import connect, differences

DATA = "/root/testdata/sf0.001"
LARGER = {"cox_model_categories": "/root/testdata/sf0.01"}  # categories of the small tables are below the thresholds
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="needs the synthetic tables")


@pytest.fixture(scope="module")
def tables():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"))
def test_query_equals_its_sql(spark, tables, name):
    con = connect(LARGER[name]) if name in LARGER else tables
    assert differences(entry.queries()[name](spark, LARGER.get(name, DATA)), con, entry.oracle_sql()[name]) is None


def test_entry(spark):
    got = entry.entry(spark).collect()
    assert [r.term for r in got] == ["x1", "x2", "prio"]
