"""Choice between reading, waiting, judging now, queueing and failing closed, from counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULTS = {"wait_ms": 10000, "infer_ms": 15000, "max_rows": 1, "slots": 64, "model_ms": 2500.0, "policy": "refresh_then_fail_closed", "force": False, "portable": False}


def plan(counts: DataFrame, **options) -> DataFrame:
    """counts (…, total, fresh, stale, missing, inflight) with the plan's quantities, path, costs in ms and freshness."""
    o = DEFAULTS | options
    refresh, inflight, fresh, total = F.col("stale") + F.col("missing"), F.col("inflight"), F.col("fresh"), F.col("total")
    zero = F.lit(0)
    now = F.least(refresh, F.lit(o["max_rows"])) if not o["force"] and not o["portable"] and o["infer_ms"] > 0 and o["max_rows"] > 0 else zero
    wait = inflight if not o["force"] and o["wait_ms"] > 0 else zero
    queue = F.least(refresh - now, F.lit(o["slots"])) if o["policy"] == "refresh_then_fail_closed" else zero
    closed = F.greatest(refresh + inflight - wait - now - queue, zero)
    d = counts.withColumns({"refresh": refresh, "infer_now": now, "wait": wait, "queued": queue, "fail_closed": closed})
    if o["force"]:
        path = F.lit("lookup_fail_closed")
    else:
        path = F.when(total == 0, "lookup").when(F.col("infer_now") > 0, "bounded_infer_now").when(F.col("wait") > 0, "wait_for_refresh").when(F.col("refresh") == 0, "lookup")
        if o["policy"] == "lookup_only":
            path = path.otherwise("lookup_fail_closed")
        else:
            path = path.when((F.col("queued") > 0) & (F.col("refresh") < total), "queue_refresh").when(F.col("queued") > 0, "full_refresh").otherwise("lookup_fail_closed")
    lookup = F.round(1 + 0.05 * fresh, 2)
    cost = F.col("lookup_ms") + F.when(F.col("path") == "bounded_infer_now", F.col("infer_ms")).when(F.col("path") == "wait_for_refresh", 0.5 * F.col("wait")).when(F.col("path").isin("queue_refresh", "full_refresh"), F.col("queue_ms") - F.col("lookup_ms")).otherwise(0.0)
    d = d.withColumn("path", path).withColumn("lookup_ms", lookup)
    d = d.withColumn("queue_ms", F.round(F.col("lookup_ms") + F.col("refresh") * o["model_ms"], 2)).withColumn("infer_ms", F.round(F.col("infer_now") * o["model_ms"], 2))
    return d.withColumn("cost_ms", F.round(cost, 2)).withColumn("freshness", F.when(total == 0, 1.0).otherwise(F.round(fresh / total, 4)))


def maintained(requests: DataFrame, statistics: DataFrame, as_of) -> DataFrame:
    """Counts of requests (task, revision, fallback) from statistics kept with the state, never from the subjects: (task, total, fresh, stale, missing, expired, count_basis).

    statistics: (task, revision, total, fresh, stale, missing, basis, valid_until), one small row a task and revision.
    Without a row everything is missing (maintained_missing); an invalid row's parts count for nothing; past valid_until all
    that was fresh is stale, as many as `expired`.
    """
    s = statistics.select("task", "revision", *(F.col(c).alias(f"s_{c}") for c in ("total", "fresh", "stale", "missing")), "basis", "valid_until")
    d = requests.join(s, ["task", "revision"], "left")
    fallback = F.greatest(F.coalesce("fallback", F.lit(0)), F.lit(0))
    invalid, late = F.col("basis") == "maintained_invalid", F.col("valid_until") <= as_of
    none = F.col("basis").isNull()
    zero = F.lit(0).cast("bigint")
    total = F.when(none, fallback).when(invalid, F.greatest("s_total", fallback)).otherwise(F.col("s_total"))
    return d.select(
        "task", total.alias("total"), F.when(none | invalid | late, zero).otherwise(F.col("s_fresh")).alias("fresh"),
        F.when(none | invalid, zero).when(late, F.col("s_fresh") + F.col("s_stale")).otherwise(F.col("s_stale")).alias("stale"),
        F.when(none | invalid, total).otherwise(F.col("s_missing")).alias("missing"), F.when(~none & ~invalid & late, F.col("s_fresh")).otherwise(zero).alias("expired"),
        F.when(none, "maintained_missing").when(invalid, "maintained_invalid").when(late, "maintained_expired").otherwise(F.col("basis")).alias("count_basis"),
    )


def eta(samples: DataFrame, backlog, rate_floor_ms: float, newest: int = 101) -> DataFrame:
    """Service time and time to catch up, by task, from the newest samples (task, priority, finished_at, id, ms) of each task's best priority class.

    backlog: jobs waiting, by task, as a column. The time to catch up is backlog times the median, and never less than the rate floor and one median.
    """
    from pyspark.sql import Window

    best = samples.groupBy("task").agg(F.min("priority").alias("priority"))
    order = Window.partitionBy("task").orderBy(F.col("finished_at").desc(), F.col("id").desc())
    kept = samples.join(best, ["task", "priority"]).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= newest)
    p = lambda q: F.expr(f"percentile_disc({q}) within group (order by ms)").cast("bigint")
    d = kept.groupBy("task").agg(F.count("*").alias("samples"), p(0.25).alias("p25"), p(0.5).alias("p50"), p(0.75).alias("p75"))
    return d.withColumn("catch_up_ms", F.greatest(backlog * F.col("p50"), F.lit(rate_floor_ms).cast("bigint") + F.col("p50")))
