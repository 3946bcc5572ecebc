"""What the physical plans must and must not hold."""

import re

import pytest

from sluice.plans import catalogue

DIR = "/root/testdata/sf0.001"
#: Ordered folds that no built-in function expresses carry an accumulator over Arrow batches.
FOLDS = ("worker_ema", "reask_points")
PYTHON = re.compile("Python|Pandas|Arrow")


def plan(spark, name):
    return catalogue.QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_no_cartesian_products_and_no_python(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert bool(PYTHON.search(text)) == (name in FOLDS)


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "stage_filter")
    assert "EqualTo(event_type,purchase)" in text and "GreaterThan(value,50.0)" in text
    assert re.search(r"ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string,value:double>", text)


@pytest.mark.parametrize("name", ["stage_map", "stage_filter", "stage_flat_map", "frame_roundtrip", "delayed_send", "app_env", "broadcast_lossless"])
def test_stateless_stages_do_not_shuffle(spark, name):
    assert "Exchange" not in plan(spark, name)


@pytest.mark.parametrize("name", ["mailbox_fifo", "counter_reset", "event_timeout", "failure_detector", "suspend_resume"])
def test_windows_shuffle_once_by_key(spark, name):
    assert len(re.findall(r"Exchange hashpartitioning\(user_id", plan(spark, name))) == 1
