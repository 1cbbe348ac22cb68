"""Scale guard: no registered query plans a global window, a cartesian/nested-loop join or a row-at-a-time UDF."""

import pytest

import __spark_entry__ as E
from lagwise.plans.guards import plan_violations

SLOW = {"lag_sweep_rf", "lag_sweep_gbt", "lag_sweep_boosted", "lag_sweep_rff", "lag_sweep_hidden", "grid_search", "grid_search_svr",
        "tree_importance", "lag_sweep_classifier", "forecast_horizon", "multi_lag_sweep"}
NAMES = sorted(n for n in E.queries() if n not in SLOW)


@pytest.mark.parametrize("name", NAMES)
def test_plan_has_no_unscalable_shape(spark, name):
    df = E.queries()[name](spark, "/root/testdata/sf0.001")
    assert plan_violations(df) == []


def test_guard_detects_global_window(spark):
    from pyspark.sql import Window, functions as F
    df = spark.range(10)
    bad = df.withColumn("r", F.row_number().over(Window.orderBy("id")))
    assert "Window over a single partition" in plan_violations(bad)
    assert "BroadcastNestedLoopJoin" in plan_violations(df.crossJoin(df.select(F.col("id").alias("j"))))
