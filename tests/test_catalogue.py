"""Every catalogued query against its SQL (those without SQL: they run and have rows)."""

import pytest

from weftgraph.plans import catalogue

@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(name, same):
    same(catalogue.QUERIES[name], catalogue.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_rows_only(name, spark, sf_dir):
    assert catalogue.QUERIES[name](spark, sf_dir).limit(1).count() == 1
