"""What happened: windows, timings, percentiles, failures and token traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def percentile(q: float, c: str, kind: str = "double") -> Column:
    """A value of the column; kind: its type, which the aggregate turns to double."""
    return F.expr(f"percentile_disc({q}) within group (order by {c})").cast(kind)


def look_back(events: DataFrame, as_of: Column, windows: dict[str, int], value: str) -> DataFrame:
    """Counts and percentiles of events (ts, kind, value) in trailing windows that end at as_of; windows in seconds, longest scanned once."""
    age = as_of.cast("timestamp").cast("long") - F.col("ts").cast("timestamp").cast("long")
    inside = F.array_compact(F.array(*(F.when(age < s, F.lit(w)) for w, s in windows.items())))
    spread = events.where((age >= 0) & (age < max(windows.values()))).withColumn("window", F.explode(inside))
    return spread.groupBy("window", "kind").agg(F.count("*").alias("n"), percentile(0.5, value).alias("p50"), percentile(0.95, value).alias("p95"), F.max(value).alias("most"))


def slo(samples: DataFrame, target_ms: int, minimum: int = 100) -> DataFrame:
    """p95 and p99 of samples (phase, ms) by phase and over all; met only with enough samples."""
    spread = samples.withColumn("phase", F.explode(F.array(F.col("phase"), F.lit("all"))))
    d = spread.groupBy("phase").agg(F.count("*").alias("n"), percentile(0.95, "ms", "bigint").alias("p95"), percentile(0.99, "ms", "bigint").alias("p99"))
    return d.withColumn("met", (F.col("n") >= minimum) & (F.col("p95") <= target_ms))


def stage_timing(jobs: DataFrame) -> DataFrame:
    """Sums of whole ms by task of jobs (task, queue_ms, run_ms, total_ms), and what the parts leave unexplained."""
    d = jobs.groupBy("task").agg(F.count("*").alias("jobs"), *(F.sum(F.ceil(c)).alias(c) for c in ("queue_ms", "run_ms", "total_ms")))
    return d.withColumn("delta_ms", F.col("total_ms") - F.col("queue_ms") - F.col("run_ms"))


def cache_status(requests: DataFrame) -> DataFrame:
    """Hit rate by model of requests (model, key, at): a hit repeats a key that was asked for before."""
    first = requests.groupBy("model", "key").agg(F.count("*").alias("n"))
    return first.groupBy("model").agg(F.sum("n").alias("requests"), F.sum(F.col("n") - 1).alias("hits"), F.round(F.sum(F.col("n") - 1).cast("double") / F.sum("n"), 9).alias("hit_rate"))


#: Stage, retryability and the owner's next step of every failure code.
TAXONOMY = {
    "canceled": ("cancellation", "manual_retry", "application_retry_job"),
    "source_contract_rejected": ("admission", "after_owner_action", "repair_workload"),
    "workload_revision_unavailable": ("claim", "after_owner_action", "repair_workload"),
    "attempts_exhausted": ("claim", "manual_retry", "application_retry_job"),
    "attempt_timeout": ("inference", "manual_retry", "application_retry_job"),
    "artifact_rejected": ("model_load", "after_owner_action", "replace_artifact"),
    "model_identity_rejected": ("model_load", "after_owner_action", "repair_worker_registration"),
    "runtime_configuration_rejected": ("admission", "after_owner_action", "repair_runtime_options"),
    "resource_admission_rejected": ("admission", "after_owner_action", "repair_runtime_capacity"),
    "output_validation_failed": ("output_validation", "after_owner_action", "inspect_model_and_contract"),
    "decision_rejected": ("selection", "never", "review_or_correct"),
    "database_contract_rejected": ("completion", "after_owner_action", "repair_database_contract"),
    "runtime_failed": ("inference", "manual_retry", "application_retry_job"),
    "terminalization_failed": ("completion", "after_owner_action", "repair_database_contract"),
    "claim_lost": ("claim", "automatic", "wait"),
    "unclassified": ("unknown", "after_owner_action", "inspect_owner_detail"),
}
_ALIASES = {"requested_context_window_exceeds_model_limit": "runtime_configuration_rejected", "request_memory_admission_rejected": "resource_admission_rejected", "strong_attempt_failed": "runtime_failed", "worker_failed": "runtime_failed"}


def failure_slug(c: Column) -> Column:
    """The taxonomy's code that an error text names, bare, as kind:slug:detail or with a version; null for another text."""
    text = F.lower(F.btrim(c))
    text = F.when(text.rlike("^[a-z_]*error:[^:]*:"), F.split_part(text, F.lit(":"), F.lit(2))).otherwise(text)
    text = F.regexp_replace(text, r"^[a-z.]*failure\.v1\.", "")
    return F.coalesce(F.when(text.isin(*TAXONOMY), text), *(F.when(text == k, F.lit(v)) for k, v in _ALIASES.items()))


def failure_code(status: Column, error: Column, stop: Column, selection: Column, validation: Column, runtime: Column) -> Column:
    """The code of a failed, rejected or canceled attempt; null for any other status.

    A cancellation is one whatever else was said; then the error, the stop reason and the selection's reason decide, in this
    order, where they name a code; then a rejection, a failed validation, a runtime that is known.
    """
    named = F.coalesce(failure_slug(error), failure_slug(stop), failure_slug(selection))
    rest = F.when(status == "rejected", "decision_rejected").when(validation == "failed", "output_validation_failed").when(runtime.isNotNull(), "runtime_failed").otherwise("unclassified")
    return F.when(status == "canceled", "canceled").when(status.isin("failed", "rejected"), F.coalesce(named, rest))


def taxonomy(spark) -> DataFrame:
    """(code, stage, retryability, owner_action): 16 rows."""
    return spark.createDataFrame([(k, *v) for k, v in TAXONOMY.items()], "code string, stage string, retryability string, owner_action string")


def metrics(samples: DataFrame, as_of: Column, windows: dict[str, int]) -> DataFrame:
    """(metric, window, task, support, value): every measure of samples (task, metric, kind, at, value) in each trailing window, in one pass.

    kind says how a metric's values are put together: p50, p95, p99, max, rate, sum or count; a sample of several kinds
    names them all, parted by commas.
    """
    age = as_of.cast("timestamp").cast("long") - F.col("at").cast("timestamp").cast("long")
    inside = F.array_compact(F.array(*(F.when(age < n, F.lit(w)) for w, n in windows.items())))
    d = samples.where((age >= 0) & (age < max(windows.values()))).withColumn("window", F.explode(inside))
    d = d.groupBy("metric", "kind", "window", "task").agg(
        F.count("value").alias("support"), *(percentile(q, "value").alias(n) for n, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))), F.max("value").cast("double").alias("max"), F.round(F.avg("value"), 9).alias("rate"), F.sum("value").cast("double").alias("sum"), F.count("value").cast("double").alias("count"),
    )
    shown = d.withColumn("how", F.explode(F.split("kind", ",")))
    value = F.coalesce(*(F.when(F.col("how") == k, F.col(k)) for k in ("p50", "p95", "p99", "max", "rate", "sum", "count")))
    return shown.select(F.concat_ws("_", "metric", "how").alias("metric"), "window", "task", "support", value.alias("value"))


def trace_steps(traces: DataFrame, key: str, values: str) -> DataFrame:
    """One row for each step of a nested trace."""
    return traces.select(key, F.posexplode(values).alias("step", "logit"))


def top_alternatives(traces: DataFrame, key: str, values: str, k: int) -> DataFrame:
    """The k greatest values of each trace with their places: sorted inside the row, no shuffle."""
    pairs = F.transform(values, lambda x, i: F.struct((-x).alias("neg"), i.alias("step"), x.alias("logit")))
    top = F.slice(F.array_sort(pairs), 1, k)
    return traces.select(key, F.posexplode(top).alias("nth", "a")).select(key, (F.col("nth") + 1).alias("nth"), F.col("a.step").alias("step"), F.col("a.logit").alias("logit"))


def trace_summary(traces: DataFrame, key: str, values: str) -> DataFrame:
    return traces.select(key, F.size(values).alias("steps"), F.array_max(values).alias("most"), F.array_min(values).alias("least"))
