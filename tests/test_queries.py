"""Every registered query against its SQL on the smallest data folder."""

import importlib

import oracle
import pytest

entry = importlib.import_module("__spark_entry__")
ORACLES = entry.oracle_sql()


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, sf, duck, name):
    result = entry.queries()[name](spark, sf)
    if name in ORACLES:
        assert oracle.differences(result, duck, ORACLES[name]) is None
    else:
        assert result.count() > 0
