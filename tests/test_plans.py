"""Every registered query stays on the JVM (no Python evaluation node) and
uses no cross join (no cartesian product or nested-loop join)."""

import pytest

import __spark_entry__ as E
from platewise.plans import catalog

SF = "/root/testdata/sf0.001"
FORBIDDEN = ["BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF",
             "CartesianProduct", "BroadcastNestedLoopJoin"]


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_plan_is_jvm_only_and_cross_join_free(spark, name):
    df = E.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    bad = [f for f in FORBIDDEN if f in plan]
    assert not bad, (name, bad)


def _formatted(spark, df):
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def test_rollup_prunes_columns(spark):
    text = _formatted(spark, E.queries()["aim_daily_rollup_total"](spark, SF))
    schema = [line for line in text.splitlines() if line.startswith("ReadSchema")][0]
    assert "o_orderdate" in schema and "o_orderkey" not in schema and "o_custkey" not in schema


def test_date_range_reaches_scan(spark):
    text = _formatted(spark, E.queries()["flt_date_range"](spark, SF))
    pushed = [line for line in text.splitlines() if line.startswith("PushedFilters")]
    assert any("GreaterThanOrEqual(date" in p and "LessThanOrEqual(date" in p for p in pushed)
