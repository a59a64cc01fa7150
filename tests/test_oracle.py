"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["ds", "node", "value"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    ok, message = compare(spark, con, entry.queries()[name], ORACLES[name], SF)
    assert ok, message


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(ORACLES)))
def test_runs_without_sql(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0
