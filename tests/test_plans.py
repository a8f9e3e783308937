"""Scale properties read from the physical plans of the registered queries."""

import pytest

import __spark_entry__ as E
from qaspark.plans.driver_queries import QUERIES
from tests.conftest import SF_SMALL


def _plan(spark, key):
    df = E.queries()[key](spark, SF_SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


#: The run grid is a product of two config tables; the index search adds k rows to each query.
PRODUCTS = {"q05_run_grid", "q07_memory_plan", "q21b_retrieve_from_index"}


@pytest.mark.parametrize("key", sorted(set(QUERIES) - PRODUCTS))
def test_no_cross_product_or_row_udf(spark, key):
    plan = _plan(spark, key)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan, f"{key}: {bad}"


def test_filters_reach_the_scan(spark):
    plan = _plan(spark, "q23_recalls")
    assert "PushedFilters: [IsNotNull(role), EqualTo(role,user)" in plan
    assert "PushedFilters: [IsNotNull(role), EqualTo(role,assistant)" in plan
    plan = _plan(spark, "q26_messages")
    assert "EqualTo(role,system)" in plan
    plan = _plan(spark, "q29_power")                             # every event is a sample: no filter, three columns
    assert "ReadSchema: struct<event_id:bigint,value:double,props:string>" in plan


def test_column_pruning(spark):
    plan = _plan(spark, "q08_run_quality")
    assert "ReadSchema: struct<conv_id:bigint>" in plan          # the run dimension reads one column


@pytest.mark.parametrize("key", ["q18_preview", "q20_retrieve_dense", "q21_retrieve_lexical"])
def test_top_k_limits_before_the_shuffle(spark, key):
    plan = _plan(spark, key)
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_recall_join_is_an_equi_join_on_salted_tokens(spark):
    plan = _plan(spark, "q19_recall_join")
    assert "xxhash64" in plan                                      # salted postings
    assert "HashJoin" in plan or "SortMergeJoin" in plan
