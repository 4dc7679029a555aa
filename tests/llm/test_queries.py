"""The registered corpus queries against their SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle_harness import compare, duck
from tillroll.llm import queries


@pytest.fixture(scope="module")
def con(sf_small):
    return duck(sf_small)


def test_registered():
    assert sorted(n.split("_")[0] for n in queries.QUERIES) == sorted(f"op{i}" for i in range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(queries.ORACLE) <= set(entry.oracle_sql()) and set(queries.ORACLE) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, sf_small, con, name):
    r = compare(spark, sf_small, name, queries.QUERIES[name], queries.ORACLE[name], con)
    assert r["status"] == "match", r


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE) - {"op12_spelling_variants"}))
def test_query_covers_its_table(spark, sf_small, name):
    got = queries.QUERIES[name](spark, sf_small)
    assert got.select("doc_id").distinct().count() == spark.read.parquet(f"{sf_small}/documents.parquet").count()
