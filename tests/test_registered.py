"""Registered queries against their SQL at the smallest scale; `checks.compare` runs them at any scale."""

import os

import pytest
from checks.compare import difference, duck

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not there")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_its_sql():
    assert set(E._own_queries()) == set(E._own_sql())


@pytest.mark.parametrize("name", sorted(set(E.queries()) & set(E.oracle_sql())))
def test_same_rows(spark, con, name):
    got = E.queries()[name](spark, SF)
    assert difference(got.toArrow(), con.sql(E.oracle_sql()[name]).to_arrow_table()) is None
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("CartesianProduct", "BroadcastNestedLoopJoin Inner", "BatchEvalPython"))
    # none of these needs a window, so none can have one over a constant key
    assert name not in E._own_queries() or "Window" not in plan
