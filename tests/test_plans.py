"""Physical-plan properties that matter at scale."""

import pytest

import __spark_entry__ as E

QUERIES = E.queries()
BATCH = sorted(n for n in QUERIES if not n.startswith("stream_"))


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_join(spark, sf_dir, name):
    plan = _plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_top_k_limits_before_the_shuffle(spark, sf_dir):
    plan = _plan(QUERIES["stratified_sample"](spark, sf_dir))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_statistics_aggregate_partially_before_the_shuffle(spark, sf_dir):
    plan = _plan(QUERIES["disparity_by_mode"](spark, sf_dir))
    assert "partial_sum" in plan and "partial_count" in plan


def test_lineitem_scan_is_pruned(spark, sf_dir):
    plan = QUERIES["disparity_by_mode"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "l_shipdate" not in plan and "l_returnflag" not in plan
