"""Every registered query: equal to its SQL, or at least a stable schema and some rows."""

import pytest
from oracle import connect, differences

import __spark_entry__ as entry_points

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    df = entry_points.entry(spark)
    assert {"sequence_id", "value__mean", "target"} <= set(df.columns)
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    assert differences(con, QUERIES[name](spark, SF), ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert len(df.columns) == len(set(df.columns))
    assert df.count() > 0
