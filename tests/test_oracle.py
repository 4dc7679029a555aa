"""Every registered query equals its DuckDB oracle on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle_harness import compare, duck
from tillroll.plans.catalog import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con(sf_small):
    return duck(sf_small)


def test_every_query_has_an_oracle():
    # Non-SQL operators would be listed here; today every query has one.
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, sf_small, con, name):
    r = compare(spark, sf_small, name, QUERIES[name], ORACLE.get(name), con)
    assert r["status"] == "match", r


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["Year", "Month", "TotalAmount", "Transactions", "UniqueCustomers", "Date"]
