"""Every registered query against its SQL, on the smallest tables."""

import pytest
from oracle import compare, connect

from __spark_entry__ import entry, oracle_sql, queries
from salestally.checks import CHECKS, SQL


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", list(queries()))
def test_rows_equal_sql(spark, con, folder, name):
    assert compare(spark, con, folder, name, queries()[name], oracle_sql().get(name)) is None


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["Identifier", "Actual Sales"] and df.count() == 10


def test_all_have_sql():
    assert set(CHECKS) == set(SQL) <= set(oracle_sql())
