"""Judges, and the cascade from a cheap to a strong one."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def triage_rule(blockers: Column, approvals: Column) -> Column:
    """Struct (decision, confidence)."""
    pick = lambda d, c: F.struct(F.lit(d).alias("decision"), F.lit(c).alias("confidence"))
    return F.when(blockers > 0, pick("flag", "high")).when(approvals > 0, pick("pass", "high")).otherwise(pick("unclear", "medium"))


def match_rule(conflicting: Column, shared: Column) -> Column:
    """Struct (match, confidence) of a candidate pair by its stable identifiers."""
    pick = lambda d, c: F.struct(F.lit(d).alias("match"), F.lit(c).alias("confidence"))
    return F.when(conflicting > 0, pick("different_entity", "high")).when(shared > 0, pick("same_entity", "high")).otherwise(pick("unclear", "medium"))


def judge(inputs: DataFrame, model: Callable[[Iterable[pd.DataFrame]], Iterable[pd.DataFrame]], schema: str) -> DataFrame:
    """A model's answers, batch by batch on the executors; equal inputs are asked once."""
    asked = inputs.dropDuplicates(["content_hash"]).mapInPandas(model, schema)
    return inputs.select("subject_id", "content_hash").join(asked, "content_hash")


_LEVELS = {"low": 0, "medium": 1, "high": 2}


def acceptance(confidence: Column, answer: Column, floor: str = "high", has_answer_field: bool = True, abstain: tuple[str, ...] = ("unclear",)) -> Column:
    """Why an attempt is or isn't accepted, the first reason that holds."""
    level = F.coalesce(*(F.when(confidence == k, F.lit(v)) for k, v in _LEVELS.items()), F.lit(-1))
    reason = F.when(confidence.isNull(), "missing_confidence_field").when(level < _LEVELS[floor], "confidence_below_policy")
    if has_answer_field:
        reason = reason.when(answer.isNull(), "missing_decision_field").when(answer.isin(*abstain), "abstained_output")
    return reason.otherwise("accepted_by_policy")


def cascade(cheap: DataFrame, strong: DataFrame) -> DataFrame:
    """Accepted cheap answers, and the strong ones of subjects whose cheap answer wasn't; both (subject_id, reason, answer)."""
    good = cheap.where("reason = 'accepted_by_policy'").withColumn("role", F.lit("cheap"))
    rest = strong.join(good.select("subject_id"), "subject_id", "left_anti").withColumn("role", F.lit("strong"))
    return good.unionByName(rest)


def direct_gate(confidence: Column, answer: Column, enforced: Column) -> Column:
    """Why an answer asked for directly is or isn't trusted; unless enforced it is."""
    return F.when(~enforced, "accepted_by_policy").otherwise(acceptance(confidence, answer))
