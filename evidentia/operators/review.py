"""What people have to look at: one queue of several sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Next step by kind; of equal age the more pressing kind comes first.
STEPS = {"suspended_authority": "review", "pending_dry_run": "dry_run", "pending_approval": "approve", "ready_to_apply": "apply", "review_flag": "review", "abstention": "label", "rejected_receipt": "inspect", "graph_conflict": "resolve", "correction_reopened": "renew", "sample": "label"}


def action_kind(kind: Column, status: Column, approval: Column, dry_run: Column, authority: Column) -> Column:
    """Where an action stands in the queue: without authority it waits for that first."""
    update = kind == "update_row"
    return (
        F.when(~authority, "suspended_authority").when(update & (dry_run == "not_run"), "pending_dry_run").when((approval == "required") & (status == "proposed"), "pending_approval")
        .when(update & (status == "approved"), "ready_to_apply").otherwise("review_flag")
    )


def queue(*branches: DataFrame) -> DataFrame:
    """The union of branches (queue_kind, item_id, task), with each item's next step."""
    rows = reduce(DataFrame.unionByName, (b.select("queue_kind", "item_id", "task") for b in branches))
    step = F.coalesce(*(F.when(F.col("queue_kind") == k, F.lit(v)) for k, v in STEPS.items()))
    return rows.withColumn("next_step", step)
