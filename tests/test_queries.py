"""Every registered query against its SQL twin over whole tables."""

import pytest
from compare import compare, connect

import __spark_entry__ as E
from lutrin.plans import QUERIES, SQL


@pytest.fixture(scope="session")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, folder, name):
    assert E.queries()[name] is QUERIES[name] and E.oracle_sql()[name] == SQL[name]
    r = compare(spark, con, name, QUERIES[name], SQL[name], folder)
    assert r["columns"][0] == r["columns"][1]
    assert len(r["got"]) == len(r["want"])
    assert r["got"] == r["want"]


def test_flagship_query(spark):
    rows = E.entry(spark)
    assert rows.columns == ["query_id", "collection_id", "n_sections", "answer", "prompt"]
    assert rows.count() > 0
