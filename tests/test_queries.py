from __future__ import annotations

import pytest
from helpers import SF, assert_same

import __spark_entry__ as entry
from attestor.plans import catalog

QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, name):
    assert_same(QUERIES[name](spark, SF), ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
