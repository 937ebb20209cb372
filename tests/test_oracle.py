"""Every query of the engine runs; those with a SQL twin return the same rows. Plans hold no cross
product, and only the plug points enter Python workers."""

import pytest

import __spark_entry__ as entry
from panelspark.plans.catalog import ORACLES, QUERIES
from tests.oracle import compare, duck

PLUGS = {"vol_forecast_garch", "score_windows", "score_texts"}


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name not in PLUGS:
        assert "EvalPython" not in plan and "InPandas" not in plan
    if name in ORACLES:
        n, m, diff, sample = compare(df, con, ORACLES[name])
        assert (n, diff) == (m, 0), sample
    else:
        assert df.columns and df.collect() is not None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "candidate_type" in df.columns
