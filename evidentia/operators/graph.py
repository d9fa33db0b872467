"""Constraints between entities: must-link and cannot-link facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import kept


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of the ids of must-link edges (left_id, right_id); label: the least id reachable. Propagates minima and halves paths until nothing changes."""
    both = edges.select(F.col("left_id").alias("a"), F.col("right_id").alias("b"))
    both = kept(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label"))
    labels = kept(labels, "labels")
    while True:
        low = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("m"))
        stepped = labels.join(low, labels["id"] == low["a"]).select("id", F.least("label", "m").alias("label"), F.col("label").alias("before"))
        up = stepped.select(F.col("id").alias("k"), F.col("label").alias("further"))
        after = kept(stepped.join(up, stepped["label"] == up["k"], "left").select("id", F.least("label", F.coalesce("further", "label")).alias("label"), "before"), "labels")
        labels = after.select("id", "label")
        if after.where("label <> before").isEmpty():
            return labels


def conflicts(must: DataFrame, cannot: DataFrame, most_must: int | None = None, most_cannot: int | None = None) -> DataFrame:
    """(left_id, right_id, status) of cannot-link facts: conflict where must-links join both ends, else consistent.

    With more facts of either kind than asked for nothing is analysed: every status is analysis_limit_exceeded.
    """
    over = lambda d, most: most is not None and d.limit(most + 1).count() > most
    if over(must, most_must) or over(cannot, most_cannot):
        return cannot.select("left_id", "right_id", F.lit("analysis_limit_exceeded").alias("status"))
    labels = components(must)
    a, b = labels.select(F.col("id").alias("left_id"), F.col("label").alias("la")), labels.select(F.col("id").alias("right_id"), F.col("label").alias("lb"))
    d = cannot.join(a, "left_id", "left").join(b, "right_id", "left")
    return d.select("left_id", "right_id", F.when(F.col("la") == F.col("lb"), "conflict").otherwise("consistent").alias("status"))


def constraint_status(facts: DataFrame, current: DataFrame) -> DataFrame:
    """facts (pair_id, source_hash, contract_hash) against the pairs' present hashes."""
    c = current.select("pair_id", F.col("source_hash").alias("s"), F.col("contract_hash").alias("c"))
    state = constraint_state(F.col("source_hash"), F.col("contract_hash"), F.col("s"), F.col("c"))
    return facts.join(c, "pair_id", "left").select("pair_id", state.alias("state"))


def constraint_state(source_hash: Column, contract_hash: Column, source_now: Column, contract_now: Column) -> Column:
    """What a fact's hashes are beside the pair's present ones, both null where the pair is none any more."""
    source, contract = ~source_hash.eqNullSafe(source_now), ~contract_hash.eqNullSafe(contract_now)
    return F.when(source_now.isNull() & contract_now.isNull(), "task_inactive").when(source & contract, "reopened_source_and_contract").when(source, "reopened_source").when(contract, "reopened_contract").otherwise("active")
