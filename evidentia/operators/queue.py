"""Work: admission, fair claiming, capacity and status, backfill pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.inputs import spread


def input_violations(inputs: DataFrame) -> DataFrame:
    """(subject_id, violation, n) of an input relation (subject_id, input): null subjects and inputs, duplicates, conflicting duplicates."""
    per = spread(inputs, "subject_id").groupBy("subject_id").agg(F.count("*").alias("n"), F.countDistinct("input").alias("kinds"), F.count_if(F.col("input").isNull()).alias("nulls"))
    kind = F.when(F.col("subject_id").isNull(), "null_subject").when(F.col("nulls") > 0, "null_input").when(F.col("kinds") > 1, "conflict").when(F.col("n") > 1, "duplicate")
    return per.withColumn("violation", kind).where("violation is not null").select("subject_id", "violation", "n")


def admission(tasks: DataFrame, row_cap: int, depth_cap: int, byte_cap: int) -> DataFrame:
    """tasks (task, new_jobs, active_jobs, largest_input) with the first limit that a run would break, or admitted."""
    why = F.when(F.col("new_jobs") > row_cap, "row_cap").when(F.col("new_jobs") + F.col("active_jobs") > depth_cap, "queue_depth_cap").when(F.col("largest_input") > byte_cap, "input_byte_cap").otherwise("admitted")
    return tasks.withColumn("decision", why)


def attempt_ms(asked: Column, policy: int) -> Column:
    """Time that an attempt may take: what was asked for, else the policy, between 1 ms and the policy."""
    return F.least(F.greatest(F.coalesce(asked, F.lit(policy)), F.lit(1)), F.lit(policy)).cast("bigint")


def lease_ms(lease: Column, attempt: Column) -> Column:
    """A lease outlives its attempt by half a minute."""
    return F.greatest(lease, attempt + 30_000).cast("bigint")


def claim(jobs: DataFrame, limit: int, as_of: Column, cursor: str = "", slots: int | None = None, lease: int = 60_000) -> DataFrame:
    """(id, task, task_rank, job_rank, leased_until, fence): the next jobs to run, in turn by task.

    jobs: (id, task, status, created_at, retries, leased_until). Queued jobs are ready, and running ones whose lease is over
    or lacking; those come first within their task, then the oldest. Tasks beyond the cursor come before the others, then
    by retries and name. At most `limit` jobs, and no more than the free slots. fence numbers the claims of a job: a worker
    with an older number has lost its lease.
    """
    now = as_of.cast("timestamp").cast("long")
    late = F.coalesce(F.col("leased_until").cast("timestamp").cast("long") < now, F.lit(True))
    ready = jobs.withColumn("expired", F.col("status").isin("running", "cancel_requested") & late).where((F.col("status") == "queued") | F.col("expired"))
    n = limit if slots is None else min(limit, slots)
    own = Window.partitionBy("task").orderBy(F.col("expired").desc(), "created_at", "id")
    ranked = ready.withColumn("job_rank", F.row_number().over(own)).where(F.col("job_rank") <= n)
    tasks = ready.groupBy("task").agg(F.min("retries").alias("retry_rank"))
    turn = Window.orderBy((F.col("task") <= cursor).cast("int"), "retry_rank", "task")  # one row a task
    tasks = tasks.withColumn("task_rank", F.row_number().over(turn).cast("bigint")).select("task", "task_rank")
    # At most n rows of each task are left, so that the merge sorts few.
    chosen = ranked.join(F.broadcast(tasks), "task").orderBy("job_rank", "task_rank").limit(n)
    return chosen.select("id", "task", "task_rank", F.col("job_rank").cast("bigint").alias("job_rank"), F.timestamp_millis((now + F.lit(lease // 1000)) * 1000).alias("leased_until"), (F.col("retries") + 1).alias("fence"))


def submitted(requests: DataFrame, known: DataFrame) -> DataFrame:
    """The first of the requests (request_key, task, subject_id, seq) for each key that isn't known: asking again submits nothing."""
    first = requests.groupBy("request_key").agg(F.min_by(F.struct("task", "subject_id", "seq"), "seq").alias("r"))
    return first.join(known.select("request_key"), "request_key", "left_anti").select("request_key", "r.*")


def subject_input(inputs: DataFrame, subject: str) -> DataFrame:
    """One subject's input: the filter reaches the scan."""
    return inputs.where(F.col("subject_id") == subject)


def new_jobs(inputs: DataFrame, active: DataFrame) -> DataFrame:
    """(subject_id, input) without the subjects that an active job (subject_id, input) of the same input works on; one whose active input differs is refused (conflict)."""
    a = active.select("subject_id", F.col("input").alias("active_input"))
    d = inputs.join(a, "subject_id", "left")
    return d.where("active_input is null or active_input <> input").select("subject_id", "input", F.col("active_input").isNotNull().alias("conflict"))


def retention(rows: DataFrame, at: str, as_of: Column, days: dict[str, int], kind: str) -> DataFrame:
    """Rows with whether they have outlived their kind's retention; kinds without one are kept."""
    age = F.coalesce(*(F.when(F.col(kind) == k, F.lit(n)) for k, n in days.items()), F.lit(None).cast("int"))
    gone = F.col(at).cast("timestamp").cast("long") + age.cast("bigint") * 86400 < as_of.cast("timestamp").cast("long")
    return rows.withColumn("expired", F.coalesce(gone, F.lit(False)))


def slices(items: DataFrame, order: list[str], count: int, size: str, most: int) -> DataFrame:
    """Items of maintenance with their slice: within each group of `task`, running sums of 1 and of a size, cut at a budget of items and of size."""
    w = Window.partitionBy("task").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = items.withColumn("n", F.count("*").over(w)).withColumn("used", F.sum(size).over(w))
    return d.withColumn("slice", F.greatest(F.ceil(F.col("n") / count), F.ceil(F.col("used") / most))).drop("n", "used")


def queue_status(jobs: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return jobs.groupBy("task").agg(F.count("*").alias("jobs"), *(count(s) for s in ("queued", "running", "complete", "failed", "cancel_requested")), F.min(F.when(F.col("status") == "queued", F.col("id"))).alias("oldest_queued"))


def capacity(status: DataFrame, slots: int) -> DataFrame:
    """Free places of each task, and its share of the queue."""
    active = F.col("queued") + F.col("running")
    total = F.sum(active).over(Window.partitionBy())  # one row a task
    return status.select("task", active.alias("active"), F.greatest(F.lit(slots) - active, F.lit(0)).alias("free"), F.round(active / F.when(total > 0, total), 6).alias("share"))


def sweep(jobs: DataFrame, lease_s: int, as_of: Column, max_attempts: int = 3) -> DataFrame:
    """Running jobs whose lease is over, requeued or failed for good; jobs with started_at and attempts."""
    late = jobs.where((F.col("status") == "running") & (F.col("started_at").cast("timestamp").cast("long") + lease_s < as_of.cast("timestamp").cast("long")))
    return late.select("id", "task", F.when(F.col("attempts") < max_attempts, "queued").otherwise("failed").alias("next_status"))


def run_status(jobs: DataFrame, receipts: DataFrame) -> DataFrame:
    """Jobs with their latest receipt; receipts: (job_id, attempt, role, generate_ms, validation)."""
    latest = receipts.groupBy("job_id").agg(F.max_by(F.struct("attempt", "role", "generate_ms", "validation"), "attempt").alias("r"))
    return jobs.join(latest, jobs["id"] == latest["job_id"], "left").select("id", "task", "status", F.coalesce("r.attempt", F.lit(0)).cast("bigint").alias("attempts"), F.col("r.role").alias("last_role"), F.col("r.validation").alias("last_validation"), F.col("r.generate_ms").alias("last_ms"))


def backfill_manifest(subjects: DataFrame, page: int) -> DataFrame:
    """(subject_id, ordinal, page): subjects in bytewise order, numbered without gathering them.

    Range partitions are counted, and each row's number is its place in its partition after the partitions before.
    """
    rows = subjects.select("subject_id").where("subject_id is not null").distinct()
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    from ..sources.storage import kept

    sorted_ = kept(rows.repartitionByRange(n, "subject_id").withColumn("part", F.spark_partition_id()), "manifest")
    counts = sorted_.groupBy("part").count()
    starts = counts.withColumn("start", F.sum("count").over(Window.orderBy("part")) - F.col("count")).select("part", "start")  # one row a partition
    numbered = sorted_.withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy("subject_id")))
    joined = numbered.join(F.broadcast(starts), "part")
    return joined.select("subject_id", (F.col("start") + F.col("nth")).alias("ordinal")).withColumn("page", F.ceil(F.col("ordinal") / page))


def backfill_status(manifest: DataFrame, done: DataFrame) -> DataFrame:
    flags = manifest.join(done.select("subject_id", F.lit(1).alias("done")).distinct(), "subject_id", "left")
    return flags.groupBy("page").agg(F.count("*").alias("subjects"), F.count("done").alias("complete"), F.min(F.when(F.col("done").isNull(), F.col("ordinal"))).alias("next_ordinal"))
