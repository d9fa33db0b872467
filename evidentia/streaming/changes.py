"""Change streams: coalescing, staleness, windows and time expiry with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.semantic import mark_stale


def split_key_changes(changes: DataFrame) -> DataFrame:
    """Changes (table, old_id, new_id, ts, seq) as (table, subject_id, reason, ts, seq): an update of the key deletes the old subject and updates the new one."""
    moved = (F.col("old_id").isNotNull()) & (F.col("new_id").isNull() | (F.col("old_id") != F.col("new_id")))
    rows = F.array_compact(F.array(F.when(moved, F.struct(F.col("old_id").alias("subject_id"), F.lit("source_delete").alias("reason"))), F.when(F.col("new_id").isNotNull(), F.struct(F.col("new_id").alias("subject_id"), F.lit("source_update").alias("reason")))))
    return changes.select("table", "ts", "seq", F.inline(rows))


def coalesced(changes: DataFrame) -> DataFrame:
    """One pending row for each (table, subject_id): its latest reason, and the number of changes as generation."""
    return changes.groupBy("table", "subject_id").agg(F.max_by("reason", F.struct("ts", "seq")).alias("reason"), F.count("*").alias("generation"))


def summed(changes: DataFrame) -> DataFrame:
    """Changes (table, subject_id, op, seq) of a batch by subject: how many inserts, updates and deletes, and the last change."""
    n = lambda op, name: F.count_if(F.col("op") == op).alias(name)
    return changes.groupBy("table", "subject_id").agg(n("insert", "inserted"), n("update", "updated"), n("delete", "deleted"), F.max("seq").alias("last_seq"))


def backoff_ms(attempts, base: int, most: int):
    return F.least(F.lit(most).cast("double"), base * F.pow(F.lit(2.0), attempts - 1)).cast("bigint")


def fold_staleness(read_state: Callable[[], DataFrame], write_state: Callable[[DataFrame, int], None], dependencies: DataFrame):
    """A foreachBatch function: each micro-batch's coalesced changes make the next version of the state; a batch seen again writes its version again."""
    def run(batch: DataFrame, number: int) -> None:
        changes = coalesced(batch).select("table", "subject_id", "reason")
        write_state(mark_stale(read_state(), changes, dependencies), number)

    return run


def tumbling(events: DataFrame, length: str, late: str | None = None) -> DataFrame:
    """Counts by kind of events (ts, kind) in tumbling windows; later than the watermark is dropped."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", length), "kind").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "kind", "n")


def sessions(events: DataFrame, key: str, gap: str, late: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), "n")


def generations(changes: DataFrame) -> DataFrame:
    """Changes with their generation within the subject, and whether a later one supersedes them."""
    order = Window.partitionBy("table", "subject_id").orderBy("ts", "seq")
    return changes.withColumn("generation", F.row_number().over(order)).withColumn("superseded", F.lead("seq").over(order).isNotNull())
