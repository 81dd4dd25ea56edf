"""Every registered query against its SQL, on whole tables."""

import pytest

import __spark_entry__ as e
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(e.queries()))
def test_query(spark, con, name):
    diff, n = compare(spark, con, SF_DIR, name, e.queries()[name], e.oracle_sql().get(name))
    assert not diff
    assert n > 0


def test_entry(spark):
    assert e.entry(spark).count() == 1


def test_every_oracle_has_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())
