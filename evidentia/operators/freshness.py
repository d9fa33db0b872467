"""Freshness of judgments: by identity of content, contract and source, and by age."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def freshness(content: Column, contract: Column, source: Column, stale: Column, reason: Column) -> Column:
    """Struct (is_fresh, stale_reason, basis). content, contract, source: whether stored and current hash are the same, nulls included."""
    corrected = reason.eqNullSafe("semantic_correction")
    none = F.lit(None).cast("string")
    verdict = lambda fresh, why, basis: F.struct(F.lit(fresh).alias("is_fresh"), why.alias("stale_reason"), basis.alias("basis"))
    same = content & contract & ~corrected
    return (
        F.when(corrected & ~stale & content & contract & source, verdict(True, none, F.lit("manual_correction")))
        .when(same & ~stale & source, verdict(True, none, F.lit("mvcc_match")))
        .when(same & ~stale, verdict(True, none, F.lit("content_hash_match")))
        .when(same & stale & reason.eqNullSafe("source_update"), verdict(True, none, F.lit("revalidated_after_benign_update")))
        .when(~contract, verdict(False, F.lit("contract_changed"), none))
        .otherwise(verdict(False, F.coalesce(reason, F.lit("content_revalidation_pending")), none))
    )


def age_state(anchor: Column, as_of: Column, max_age_s: Column, window_s: Column) -> Column:
    """disabled, time_expired, refresh_due or fresh; ages in seconds."""
    age = as_of.cast("timestamp").cast("long") - anchor.cast("timestamp").cast("long")
    return F.when(max_age_s.isNull(), "disabled").when(age >= max_age_s, "time_expired").when(age >= max_age_s - window_s, "refresh_due").otherwise("fresh")
