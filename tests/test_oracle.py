"""Every checked query equals its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect
from conftest import SF


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("key", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, key):
    state, note = compare(spark, con, SF, key)
    assert state == "ok", note
