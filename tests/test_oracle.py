"""Every registered query with an oracle matches DuckDB at sf0.001; the
rows-only queries run and return rows."""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from oracle_util import SF001, compare, duck

ORACLE_KEYS = sorted(E.oracle_sql())
ROWS_ONLY = sorted(set(E.queries()) - set(E.oracle_sql()))


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("name", ORACLE_KEYS)
def test_matches_oracle(spark, con, name):
    compare(spark, SF001, name, con)


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only(spark, name):
    assert E.queries()[name](spark, SF001).count() > 0


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() >= 1
    assert df.columns == E.entry(spark).columns


def test_every_key_documented():
    # every planned SURVEY key that is registered has a callable
    for name, fn in E.queries().items():
        assert callable(fn), name
