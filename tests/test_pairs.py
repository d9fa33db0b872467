"""Pairs are made and judged row by row: nothing that grows with their number is shuffled, and a block of any size is spread."""

import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from evidentia.plans import registry
from evidentia.sources import inputs

SF = "/root/testdata/sf0.001"


@pytest.fixture
def shuffled_joins(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_a_large_block_are_whole_and_spread(spark, monkeypatch, shuffled_joins):
    """F1"""
    monkeypatch.setattr(inputs, "CHUNK", 20)
    rows = spark.range(300).select(F.col("id").alias("k"), F.when(F.col("id") < 290, "hot").when(F.col("id") < 298, "cold").alias("block"), (F.col("id") % 7).alias("x"))
    pairs = inputs.candidate_pairs(rows, "k", "block", carried=("x",))
    found = pairs.withColumn("task", F.spark_partition_id()).collect()
    expected = [*combinations(range(290), 2), *combinations(range(290, 298), 2)]
    assert sorted((r["left_id"], r["right_id"]) for r in found) == expected
    assert all(r["subject_id"] == f"{r['left_id']}:{r['right_id']}" and r["left_x"] == r["left_id"] % 7 and r["right_x"] == r["right_id"] % 7 for r in found)
    per = [sum(r["task"] == t for r in found) for t in {r["task"] for r in found}]
    assert len(per) > 8 and max(per) < len(expected) / 4


@pytest.mark.parametrize("name", ["pair_candidates", "pair_reconcile", "pair_matches", "pair_match_auto", "pair_constraint_status", "pair_exact_counts", "pair_plan", "er_quality", "pair_refresh_inputs", "pair_current_rows"])
def test_no_pair_is_shuffled(spark, shuffled_joins, name):
    """F1 to F10"""
    plan = _plan(registry.queries()[name](spark, SF))
    assert not re.search(r"hashpartitioning\((_subject|s_subject_id|subject_id|pair_id|left_id|right_id)#", plan)
