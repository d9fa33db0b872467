"""Row and pair indexes of judgments: current rows, states, predicates as joins, counts and refresh.

inputs: (subject_id, content_hash, contract_hash, source_hash); state: (id, subject_id, body, content_hash, contract_hash,
source_hash, stale, stale_reason, updated_at). Readers are fail-closed: what isn't fresh matches nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .freshness import freshness


def current_rows(inputs: DataFrame, state: DataFrame, fresh_only: bool = True) -> DataFrame:
    """The latest judgment of each input, those of the same content and contract first, with its freshness."""
    s = state.select([F.col(c).alias(f"s_{c}") for c in state.columns])
    joined = inputs.join(s, inputs["subject_id"] == s["s_subject_id"])
    content, contract, _ = _same()
    order = Window.partitionBy("subject_id").orderBy((content & contract).desc(), F.col("s_updated_at").desc(), F.col("s_id").desc())
    rows = judged_rows(joined.withColumn("nth", F.row_number().over(order)).where("nth = 1"))
    return rows.where("is_fresh") if fresh_only else rows


def _same() -> tuple[Column, ...]:
    return tuple(F.col(f"{k}_hash").eqNullSafe(F.col(f"s_{k}_hash")) for k in ("content", "contract", "source"))


def judged_rows(beside: DataFrame, *more: str) -> DataFrame:
    """current_rows of inputs that stand beside their one judgment (s_…), row by row and without a shuffle; where s_subject_id is null there is no judgment, and nothing but the subject in the row. more: columns handed through."""
    verdict = F.when(F.col("s_subject_id").isNotNull(), freshness(*_same(), F.col("s_stale"), F.col("s_stale_reason")))
    row = F.struct("subject_id", F.col("s_body").alias("body"), verdict.alias("f"), *more)
    once = beside.select(F.inline(F.array(row)))  # a filter of these rows isn't put in the place where they come from, with all that a verdict consists of written out each time it is named
    return once.select("subject_id", "body", "f.is_fresh", "f.stale_reason", F.col("f.basis").alias("freshness_basis"), *more)


def matching(current: DataFrame, holds: Column) -> DataFrame:
    return current.where(F.col("is_fresh") & holds).select("subject_id")


def semantic_filter(rows: DataFrame, key: str, current: DataFrame, holds: Column) -> DataFrame:
    """The rows whose subject's fresh judgment holds: a semi join."""
    return rows.join(matching(current, holds).withColumnRenamed("subject_id", "_subject"), rows[key].cast("string") == F.col("_subject"), "left_semi")


def semantic_exclude(rows: DataFrame, key: str, current: DataFrame, holds: Column) -> DataFrame:
    """The rows whose subject has no fresh judgment that holds: an anti join."""
    return rows.join(matching(current, holds).withColumnRenamed("subject_id", "_subject"), rows[key].cast("string") == F.col("_subject"), "left_anti")


def states(inputs: DataFrame, current: DataFrame, inflight: DataFrame, holds: Column) -> DataFrame:
    """(subject_id, state, stale_reason): fresh_match, fresh_non_match, in_flight, stale or missing; work in flight hides the last two."""
    flags = current.select("subject_id", "is_fresh", "stale_reason", holds.alias("holds"))
    joined = inputs.select("subject_id").join(flags, "subject_id", "left").join(inflight.select("subject_id", F.lit(True).alias("queued")).distinct(), "subject_id", "left")
    state = F.when(F.col("is_fresh") & F.col("holds"), "fresh_match").when(F.col("is_fresh"), "fresh_non_match").when(F.col("queued"), "in_flight").when(F.col("is_fresh").isNull(), "missing").otherwise("stale")
    return joined.select("subject_id", state.alias("state"), F.when(state == "stale", F.col("stale_reason")).alias("stale_reason"))


def predicate_counts(states_: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("state") == s).alias({"in_flight": "inflight"}.get(s, s))
    return states_.agg(F.count("*").alias("total"), *(count(s) for s in ("fresh_match", "fresh_non_match", "stale", "missing", "in_flight")))


def revalidated(state: DataFrame, current: DataFrame) -> DataFrame:
    """The next version of the state: stale rows whose content proved unchanged are fresh again."""
    benign = current.where("is_fresh and freshness_basis = 'revalidated_after_benign_update'").select("subject_id", F.lit(True).alias("benign"))
    joined = state.join(benign, "subject_id", "left")
    clear = F.coalesce("benign", F.lit(False)) & F.col("stale")
    return joined.select(*(F.when(clear, F.lit(False)).otherwise(F.col("stale")).alias("stale") if c == "stale" else F.when(~clear, F.col(c)).alias(c) if c == "stale_reason" else F.col(c) for c in state.columns))


def refresh_inputs(inputs: DataFrame, state: DataFrame) -> DataFrame:
    """Inputs without a judgment of the same content and contract that isn't stale."""
    good = state.where("not stale").select("subject_id", "content_hash", "contract_hash").distinct()
    return inputs.join(good, ["subject_id", "content_hash", "contract_hash"], "left_anti")


def reconcile(candidates: DataFrame, state: DataFrame) -> DataFrame:
    """(subject_id, transition) of pairs: added, removed, changed, restored or unchanged; both (subject_id, content_hash), state with stale_reason."""
    c = candidates.select("subject_id", F.col("content_hash").alias("now"))
    s = state.select("subject_id", F.col("content_hash").alias("was"), "stale_reason")
    joined = c.join(s, "subject_id", "full")
    return joined.select("subject_id", transition(F.col("now"), F.col("was"), F.col("stale_reason")).alias("transition"))


def transition(now: Column, was: Column, stale_reason: Column) -> Column:
    """What became of a pair whose content's hash is now and was so, null where there is and was none."""
    return F.when(was.isNull(), "added").when(now.isNull(), "removed").when(now != was, "changed").when(stale_reason.eqNullSafe("candidate_removed"), "restored").otherwise("unchanged")


def mark_stale(state: DataFrame, changes: DataFrame, dependencies: DataFrame) -> DataFrame:
    """The next version of the state after source changes (table, subject_id, reason).

    dependencies: (dependent, table, subject_id, field). A change of the subject itself gives its own reason; one of a
    dependency gives source_update if it is the subject's, else content_revalidation_pending. contract_changed stays.
    """
    hits = changes.join(dependencies, ["table", "subject_id"]).select(
        F.col("dependent").alias("subject_id"),
        F.when(F.col("subject_id") == F.col("dependent"), F.col("reason")).when(F.col("field") == "subject_id", "source_update").otherwise("content_revalidation_pending").alias("new_reason"),
        F.when(F.col("subject_id") == F.col("dependent"), 0).when(F.col("field") == "subject_id", 1).otherwise(2).alias("rank"),
    )
    best = hits.groupBy("subject_id").agg(F.min_by("new_reason", F.struct("rank", "new_reason")).alias("new_reason"))
    joined = state.join(best, "subject_id", "left")
    take = F.col("new_reason").isNotNull() & ~F.col("stale_reason").eqNullSafe("contract_changed")
    return joined.select(*(F.when(take, F.lit(True)).otherwise(F.col("stale")).alias("stale") if c == "stale" else F.when(take, F.col("new_reason")).otherwise(F.col(c)).alias(c) if c == "stale_reason" else F.col(c) for c in state.columns))


def materialize(inputs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Records of the latest complete job whose input is the subject's present one; jobs: (id, subject_id, content_hash, status, body, finished_at)."""
    done = jobs.where("status = 'complete'")
    order = Window.partitionBy("subject_id").orderBy(F.col("finished_at").desc(), F.col("id").desc())
    joined = inputs.join(done, ["subject_id", "content_hash"]).withColumn("nth", F.row_number().over(order)).where("nth = 1")
    return joined.select("subject_id", "content_hash", F.col("id").alias("job_id"), "body")


def unresolved(inputs: DataFrame, current: DataFrame, inflight: DataFrame, limit: int) -> DataFrame:
    """The first `limit` inputs, in bytewise order of subject, that have no fresh judgment and no work in flight: what may be judged at once."""
    rest = inputs.join(current.where("is_fresh").select("subject_id"), "subject_id", "left_anti").join(inflight.select("subject_id").distinct(), "subject_id", "left_anti")
    return rest.orderBy("subject_id").limit(limit)


def semantic_filter_auto(rows: DataFrame, key: str, inputs: DataFrame, current: DataFrame, inflight: DataFrame, judged: Column, holds: Column, limit: int) -> DataFrame:
    """semantic_filter, with up to `limit` subjects that lack a fresh judgment judged now; judged: whether such an input matches."""
    now = unresolved(inputs, current, inflight, limit).where(judged).select("subject_id")
    found = matching(current, holds).unionByName(now).withColumnRenamed("subject_id", "_subject")
    return rows.join(found, rows[key].cast("string") == F.col("_subject"), "left_semi")


def judged_rows_auto(rows: DataFrame, inflight: Column, judged: Column, holds: Column, limit: int) -> DataFrame:
    """semantic_filter_auto over judged_rows: (subject_id) of those whose fresh judgment holds, and of those of the first `limit` unresolved ones, in bytewise order, that match when judged now."""
    fresh = F.coalesce("is_fresh", F.lit(False))
    now = rows.where(~fresh & ~F.coalesce(inflight, F.lit(False))).orderBy("subject_id").limit(limit).where(judged).select(F.col("subject_id").alias("_now")).distinct()
    found = rows.join(F.broadcast(now), F.col("subject_id") == F.col("_now"), "left")  # at most `limit`
    return found.where(fresh & holds | F.col("_now").isNotNull()).select("subject_id")


def exact_counts(inputs: DataFrame, current: DataFrame) -> DataFrame:
    """One row: total, fresh, stale and missing subjects, and an object of the stale ones' reasons; rows and pairs alike."""
    return flag_counts(inputs.select("subject_id").join(current.select("subject_id", "is_fresh", "stale_reason"), "subject_id", "left"))


def flag_counts(flags: DataFrame, times: Column | None = None) -> DataFrame:
    """exact_counts of subjects (is_fresh, stale_reason), is_fresh null without a judgment, read once; times: how many subjects a row stands for."""
    from ..functions.jsonx import object_of

    reason = F.when(~F.col("is_fresh"), F.coalesce("stale_reason", F.lit("content_revalidation_pending")))
    per = flags.groupBy("is_fresh", reason.alias("reason")).agg(F.sum(F.lit(1) if times is None else times).cast("bigint").alias("n"))
    many = lambda of: F.coalesce(F.sum(F.when(of, F.col("n"))), F.lit(0)).cast("bigint")
    fresh = F.col("is_fresh")
    named = F.when(F.col("reason").isNotNull(), F.col("n"))  # what has no value isn't in the object
    return per.agg(many(F.lit(True)).alias("total"), many(fresh).alias("fresh"), many(~fresh).alias("stale"), many(fresh.isNull()).alias("missing"), object_of(F.col("reason"), named).alias("stale_reasons"))


def needs_work(transitions: DataFrame, current: DataFrame) -> DataFrame:
    """(subject_id, transition) of the pairs that must be judged: added, changed or restored ones, and unchanged ones whose judgment isn't fresh."""
    fresh = current.where("is_fresh").select("subject_id", "is_fresh")
    return to_judge(transitions.join(fresh, "subject_id", "left"))


def to_judge(moved: DataFrame) -> DataFrame:
    """needs_work of pairs whose transition and is_fresh, true or else, stand side by side."""
    return moved.where("transition <> 'removed' and (transition <> 'unchanged' or not coalesce(is_fresh, false))").select("subject_id", "transition")


def batches(subjects: DataFrame, size: int = 64) -> DataFrame:
    """(subject_id, batch): batches of `size` subjects in bytewise order, numbered from 1 as backfill pages are."""
    from .queue import backfill_manifest

    return backfill_manifest(subjects, size).select("subject_id", F.col("page").alias("batch"))


def upserted(records: DataFrame, new: DataFrame) -> DataFrame:
    """The next version of records (subject_id, content_hash, job_id, body) after new ones: one for each subject, the new where there is one; record_id names subject and job."""
    kept = records.join(new.select("subject_id"), "subject_id", "left_anti")
    both = kept.select("subject_id", "content_hash", "job_id", "body").unionByName(new.select("subject_id", "content_hash", "job_id", "body"))
    return both.withColumn("record_id", F.sha2(F.concat_ws("/", "subject_id", F.col("job_id").cast("string")), 256))


def completed(job_id, inputs: DataFrame, jobs: DataFrame) -> DataFrame:
    """The record of one complete job, if its input is still the subject's."""
    return materialize(inputs, jobs.where(F.col("id") == job_id))
