"""Every registered query against its check SQL on the smallest data."""

import pytest
from checking import connect, difference

from tidewater.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, con, name):
    problem = difference(QUERIES[name](spark, sf_dir), con, ORACLES[name])
    assert problem is None, problem


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as contract

    df = contract.entry(spark)
    assert df.count() > 0 and len(df.columns) == 15
    assert set(contract.oracle_sql()) <= set(contract.queries())
