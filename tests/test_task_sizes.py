"""What a task sorts and aggregates is bounded by rows, not by the number of shuffle partitions."""

import re

from auditloom.queries import evaluation, relational
from auditloom.sources import fixtures as fx

DIR = "/root/testdata/sf0.001"


def test_lines_of_a_task_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(fx, "TASK_ROWS", 200)
    want = -(-fx.table(spark, DIR, "lineitem").count() // 200)
    for df in (fx.facts(spark, DIR), fx.predictions(spark, DIR), fx.gold(spark, DIR), fx.splits(spark, DIR)):
        assert df.rdd.getNumPartitions() == want


def test_split_summary_expands_no_rows(spark):
    plan = evaluation.split_summary(spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan


def test_label_universe_brings_bounded_lines_down_to_parts(spark, monkeypatch):
    monkeypatch.setattr(fx, "TASK_ROWS", 200)
    want = -(-fx.table(spark, DIR, "lineitem").count() // 200)
    plan = relational.label_universe(spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"hashpartitioning\([lp]_partkey#\d+L, (\d+)", plan)) == {str(want)}
