"""What the physical plans must not contain, and what they must."""

from __future__ import annotations

import re

import pytest

from parlance.plans import QUERIES
from parlance.plans.registry import Tables

# Windows over one row per partition (row numbers) and global totals are one-row-per-task inputs.
SINGLE = {"opinion_rejects", "eval_questions", "eval_prompts", "eval_records", "copy_tables", "feedback_summary"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_quadratic_or_single_task_plans(spark, data, name):
    plan = plan_of(QUERIES[name](spark, data))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in plan
    if name not in SINGLE:
        assert "SinglePartition" not in plan
    assert plan.count("ArrowEvalPython") <= 1 or name == "kb_citations"


@pytest.mark.parametrize("name, columns", [
    ("billing_history", {"o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate", "o_orderpriority"}),
    ("feedback_sentiment", {"user_id", "ts", "event_type"}), ("vector_norms", {"vec_id", "embedding"}),
    ("opinion_summary", {"text"}),
])
def test_scans_read_only_what_is_used(spark, data, name, columns):
    schemas = re.findall(r"ReadSchema: struct<(.*?)>(?=$|\n|,? )", plan_of(QUERIES[name](spark, data)))
    for schema in schemas:
        assert set(re.findall(r"(?:^|,)(\w+):", schema)) <= columns


def test_top_n_is_limited_before_the_shuffle(spark, data):
    for name in ("chat_last_n", "semantic_topk", "keyword_topk"):
        plan = plan_of(QUERIES[name](spark, data))
        assert plan.index("WindowGroupLimit") < plan.rindex("WindowGroupLimit")


def test_filters_reach_the_scan(spark, data):
    plan = plan_of(Tables(spark, data).conversations.where("role = 'user'").select("conv_id"))
    assert "EqualTo(role,user)" in plan


def test_results_do_not_depend_on_partitioning(spark, data):
    for name in ("ticket_history", "semantic_self_join", "eval_questions"):
        before = sorted(map(repr, QUERIES[name](spark, data).collect()))
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        try:
            assert sorted(map(repr, QUERIES[name](spark, data).collect())) == before
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
