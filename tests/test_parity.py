"""Every query that has a DuckDB equivalent agrees with it."""

from __future__ import annotations

import pytest

from tests.compare import agree
from tidemark.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_duckdb(spark, name):
    def checked(session, sf_dir):
        df = QUERIES[name](session, sf_dir)
        assert "CartesianProduct" not in df._jdf.queryExecution().executedPlan().toString()
        return df

    agree(spark, SF, checked, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
