"""What the physical plans must and must not contain."""

from __future__ import annotations

import pytest

from watchloom.plans import catalog

catalog.load_all()


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "rule_scan", "sliding_count", "telemetry_features", "ewma_rows", "ioc_match_all", "ioc_user_agent", "fim_alerts",
    "correlate_global", "plan_actions", "fleet", "report_rollup", "sigma_match", "beacon_score", "hunt_where",
])
def test_no_cross_product_and_no_row_python(spark, folder, name):
    plan = _plan(catalog.QUERIES[name](spark, folder))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan


@pytest.mark.parametrize("name", ["ewma_rows", "telemetry_features", "sliding_count", "beacon_score", "ioc_match_all"])
def test_stays_in_the_jvm(spark, folder, name):
    plan = _plan(catalog.QUERIES[name](spark, folder))
    assert "InPandas" not in plan and "ArrowEvalPython" not in plan


def test_scan_prunes_columns_and_pushes_filters(spark, folder):
    plan = _plan(catalog.QUERIES["devices_by_group"](spark, folder))
    assert "c_acctbal" not in plan and "PushedFilters: [IsNotNull(c_mktsegment), EqualTo(c_mktsegment,BUILDING)]" in plan


def test_top_lists_need_no_global_sort(spark, folder):
    assert "TakeOrderedAndProject" in _plan(catalog.QUERIES["hunt_default"](spark, folder))
