"""Every query with an SQL equivalent gives the same rows, names and types in DuckDB."""

import pytest

import __spark_entry__ as entry
from compare import connect, difference
from gradeloom.plans.oracles import ORACLES as SQL
from gradeloom.plans.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_registry():
    assert set(SQL) <= set(QUERIES) <= set(entry.queries())
    assert set(SQL) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf_dir, con, name):
    assert difference(QUERIES[name](spark, sf_dir), con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert {r.model for r in entry.entry(spark).collect()} == {"by_pga", "by_age", "by_roof", "blend"}
