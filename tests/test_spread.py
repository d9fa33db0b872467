"""What a task sorts or counts doesn't grow with the table: there are as many tasks as its bytes ask for."""

import re

import pytest

from evidentia.operators import evaluation
from evidentia.plans import registry
from evidentia.sources import inputs

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("name", "keys"), [("coverage_gates", "source#"), ("coverage_report", "source#"), ("operational_metrics", "id#"), ("input_relation_violations", "subject_id#")])
def test_tasks_grow_with_the_table(spark, monkeypatch, name, keys):
    """F11 to F14"""
    parts = []
    for task_bytes in (20_000, 2_000):
        monkeypatch.setattr(inputs, "TASK_BYTES", task_bytes, raising=False)
        plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        parts.append(max([int(n) for n in re.findall(rf"hashpartitioning\({keys}.*, (\d+)\), REPARTITION_BY_NUM", plan)] or [0]))
    assert parts[0] > 0 and parts[1] >= 5 * parts[0]


def test_coverage_counts_what_the_joins_did(spark):
    """Nulls match nothing; a query without candidates, an item that none is, and a lone candidate."""
    candidates = spark.createDataFrame([("a", 1, 10, 1), ("a", 1, 11, 2), ("a", 1, 12, 3), ("a", 1, None, 4), ("a", 2, 10, 1), (None, 3, 10, 1)], "source string, query int, item int, rank int")
    positives = spark.createDataFrame([("a", 1, 12), ("a", 1, 11), ("a", 1, None), ("a", 2, 10), ("a", 4, 10), (None, 3, 10)], "source string, query int, item int")
    size = candidates.groupBy("source", "query").agg({"rank": "max"}).withColumnRenamed("max(rank)", "n")
    found = positives.join(candidates, ["source", "query", "item"], "left").join(size, ["source", "query"], "left")
    expected = {}
    for r in found.collect():
        expected.setdefault(r["source"], []).append((r["rank"] is not None and r["rank"] <= 2, 1.0 if r["rank"] is None else 0.0 if r["n"] <= 1 else (r["rank"] - 1) / (r["n"] - 1)))
    got = {r["source"]: (r["positives"], r["in_bounded"], r["mean_rank"]) for r in evaluation.coverage(candidates, positives, 2).collect()}
    assert got == {s: (len(x), sum(i for i, _ in x), round(sum(p for _, p in x) / len(x), 12)) for s, x in expected.items()}
    report = evaluation.coverage_report(candidates, positives, 2).first()
    assert (report["positives"], report["in_candidates"], report["in_bounded"], report["missed"]) == (6, 3, 2, 3)
