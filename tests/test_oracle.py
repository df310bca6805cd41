"""Every registered query against its SQL in DuckDB, on the whole given tables."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry_module
from timberline.plans import registry


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("case", registry.cases(), ids=lambda c: c.name)
def test_query_matches_sql(spark, con, sf_dir, case):
    assert compare(spark, con, case, sf_dir) > 0


def test_entry_contract(spark):
    assert entry_module.entry(spark).columns[:2] == ["event_id", "timestamp"]
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
