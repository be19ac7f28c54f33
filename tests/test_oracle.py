"""Every registered query against its SQL; CASEWRIGHT_SF picks the scale."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF_DIR = f"/root/testdata/sf{os.environ.get('CASEWRIGHT_SF', '0.001')}"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    if name in SQL:
        assert compare(df, con, SQL[name]) is None
    else:
        assert df.count() >= 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
