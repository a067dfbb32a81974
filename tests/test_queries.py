import pytest
from conftest import rows_of

import __spark_entry__ as entry
from fathom.plans.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf, duck, name):
    got, expected = QUERIES[name](spark, sf).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows_of(got) == rows_of(expected)


def test_entry_and_registration(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_arms_differ(spark, sf):
    row = QUERIES["o11_arms_differ"](spark, sf).first()
    assert row["differ"] and row["rows_pre"] > 0
