"""Plan-shape guards: pushdown, pruning, group limits, and no Cartesian products."""

import pytest

SF = "/root/testdata/sf0.001"


def plan_of(spark, name):
    from __spark_entry__ import queries

    df = queries()[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_reaches_scan(spark):
    p = plan_of(spark, "filter_active")
    assert "GreaterThan(n_chars,1000)" in p and "ReadSchema: struct<doc_id:bigint,source:string,n_chars:bigint>" in p


def test_stratified_sample_limits_before_shuffle(spark):
    p = plan_of(spark, "stratified_sample")
    assert "WindowGroupLimit" in p and "Partial" in p


def test_prompt_grid_of_lists_is_a_generator_not_a_join(spark):
    p = plan_of(spark, "prompt_kinds")
    assert "Generate" in p and "Join" not in p and "CartesianProduct" not in p


def test_prompt_grid_of_tables_joins_small_tables_by_number(spark):
    p = plan_of(spark, "prompt_grid")
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p and "NestedLoop" not in p


def _plannable():
    from shiftkit.plans.registry import QUERIES

    return sorted(set(QUERIES) - {"classifier_accuracy", "variant_auroc", "incremental_prompts"})


@pytest.mark.parametrize("name", _plannable())
def test_no_cartesian_and_no_row_udf(spark, name):
    p = plan_of(spark, name)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in p, bad
