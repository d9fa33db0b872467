"""Human corrections that override judgments while what they were made for still holds.

corrections: (correction_id, subject_id, body, source_hash, content_hash, contract_hash, created_at, expires_at, supersedes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(corrections: DataFrame) -> DataFrame:
    """Of each subject the last correction that no other supersedes; of equal times the least id."""
    gone = corrections.where("supersedes is not null").select(F.col("supersedes").alias("correction_id")).distinct()
    live = corrections.join(gone, "correction_id", "left_anti")
    order = F.struct(F.col("created_at"), -F.col("correction_id"))
    kept = live.groupBy("subject_id").agg(F.max_by(F.struct(*live.columns), order).alias("c"))
    return kept.select("c.*")


def effective(state: DataFrame, corrections: DataFrame, as_of: Column) -> DataFrame:
    """state with the correction's body, staleness and reason where there is one.

    A correction applies until it expires, while the judgment's source, content and contract are those it was made for and
    the judgment isn't stale for another reason than an update of the source; one that doesn't apply makes the subject stale.
    """
    c = latest(corrections).select("subject_id", F.col("body").alias("c_body"), F.col("source_hash").alias("c_source"), F.col("content_hash").alias("c_content"), F.col("contract_hash").alias("c_contract"), "expires_at", "correction_id")
    d = state.join(c, "subject_id", "left")
    same = (F.col("c_source") == F.col("source_hash")) & (F.col("c_content") == F.col("content_hash")) & (F.col("c_contract") == F.col("contract_hash"))
    applies = F.coalesce((F.col("expires_at") > as_of) & same & (~F.col("stale") | (F.col("stale_reason") == "source_update")), F.lit(False))
    has = F.col("correction_id").isNotNull()
    return d.select(
        "subject_id", F.when(has, F.col("c_body")).otherwise(F.col("body")).alias("body"),
        F.when(~has, F.col("stale")).when(~applies, True).otherwise(F.col("stale_reason").eqNullSafe("source_update")).alias("stale"),
        F.when(has & applies & ~F.col("stale"), "semantic_correction").when(has & ~applies, F.coalesce("stale_reason", F.lit("correction_reopened"))).otherwise(F.col("stale_reason")).alias("stale_reason"),
        "correction_id",
    )


def status(corrections: DataFrame, current: DataFrame, as_of: Column) -> DataFrame:
    """(correction_id, subject_id, status): superseded, source_missing, expired, reopened_source, reopened_contract or active; current: (subject_id, content_hash, contract_hash)."""
    successor = corrections.where("supersedes is not null").select(F.col("supersedes").alias("correction_id"), F.lit(True).alias("superseded")).distinct()
    now = current.select("subject_id", F.col("content_hash").alias("now_content"), F.col("contract_hash").alias("now_contract"))
    d = corrections.join(successor, "correction_id", "left").join(now, "subject_id", "left")
    what = (
        F.when(F.col("superseded"), "superseded").when(F.col("now_content").isNull(), "source_missing").when(F.col("expires_at") <= as_of, "expired")
        .when(F.col("content_hash") != F.col("now_content"), "reopened_source").when(F.col("contract_hash") != F.col("now_contract"), "reopened_contract").otherwise("active")
    )
    return d.select("correction_id", "subject_id", what.alias("status"))
