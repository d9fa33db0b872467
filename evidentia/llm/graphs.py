"""Components of links, and links found in buckets, of tables too large for one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for every id of edges (src, dst): label is the smallest id that can be reached.

    Alternates large-star and small-star steps, each a join and an aggregation with map-side combining, until every edge
    leads to its component's smallest id. A hub's rows are never gathered: only its minimum is, and the join on it is one
    that adaptive execution splits when skewed. Null ids and loops are no edges; an empty table has no components.
    """
    now = keep(edges.where("src <> dst").select(F.greatest("src", "dst").alias("v"), F.least("src", "dst").alias("u")).distinct(), "edges")
    while True:
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.join(low, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        small_low = large.groupBy("v").agg(F.min("u").alias("m"))
        joined = large.join(small_low, "v")
        small = joined.select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(joined.select("v", F.col("m").alias("u"))).where("v <> u").distinct()
        after = keep(small, "edges")
        # Done once no smaller end is itself the larger end of an edge, and none has two smaller ends.
        tangled = after.groupBy("v").count().where("count > 1").select("v").unionByName(after.join(after.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("v"))
        now = after
        if tangled.isEmpty():
            roots = now.select("u").distinct().select(F.col("u").alias("id"), F.col("u").alias("label"))
            return now.select(F.col("v").alias("id"), F.col("u").alias("label")).unionByName(roots)


def relabelled(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """labels (id, label) after more links (src, dst): only the components that these join are worked out anew."""
    if labels is None:
        return keep(components(links), "labels")
    of = lambda name: labels.select(F.col("id").alias(name), F.col("label").alias(f"{name}_label"))
    ends = links.join(of("src"), "src", "left").join(of("dst"), "dst", "left")
    merged = keep(components(ends.select(F.coalesce("src_label", "src").alias("src"), F.coalesce("dst_label", "dst").alias("dst"))), "merged")
    after = labels.join(merged.select(F.col("id").alias("label"), F.col("label").alias("lower")), "label", "left").select("id", F.coalesce("lower", "label").alias("label"))
    # Ends that had no label are named by the merged components themselves.
    return keep(after.unionByName(merged.join(labels.select("id"), "id", "left_anti")), "labels")


#: Leaders of a bucket in one round, at most; all others have their rounds.
MOST_LEADERS = 512


def linked(members: DataFrame, verify: Callable[[DataFrame], DataFrame | None], labels: DataFrame | None = None, near: Callable[[DataFrame], Column] | None = None) -> DataFrame | None:
    """(id, label) of the components of all links within buckets; ids without a link may be missing, None: no link at all.

    members: (bucket, id, …), each once. verify gives the links (src, dst) among pairs (id, leader, home), or None; pairs of one
    home share a bucket, so that what they need may be brought together once. In a bucket,
    members are compared with leaders rather than with each other: at first the least id, then, only where a bucket still
    spans several components, more leaders each round, until all its members are in one component or have been compared. No
    bucket is gathered, no pair is compared twice, and none within a component. near: a condition on the rows of members
    joined with their leaders, whose own columns are named leader_…, without which a pair isn't compared.
    """
    more = [c for c in members.columns if c not in ("bucket", "id")]
    leaders, compared = 1, None
    while True:
        if labels is None:
            labelled = members.withColumn("label", F.col("id"))
        else:
            labelled = members.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
        open_ = labelled.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("bucket")
        labelled = keep(labelled.join(open_, "bucket"), "open")
        if labelled.isEmpty():
            return labels
        order = Window.partitionBy("bucket").orderBy("id")
        chosen = labelled.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= leaders).select("bucket", F.col("id").alias("leader"), F.col("label").alias("leader_label"), F.hash("bucket").alias("home"), *(F.col(c).alias(f"leader_{c}") for c in more))
        both = labelled.join(chosen, "bucket").where((F.col("label") != F.col("leader_label")) & (F.col("id") > F.col("leader")))
        pairs = (both.where(near(both)) if near else both).groupBy("id", "leader").agg(F.min("home").alias("home"))
        if compared is not None:
            pairs = pairs.join(compared, ["id", "leader"], "left_anti")
        pairs = keep(pairs, "pairs")
        done = pairs.select("id", "leader")
        compared = done if compared is None else compared.unionByName(done)
        found = verify(pairs)
        if found is not None and not found.isEmpty():
            labels = relabelled(labels, found)
        members = keep(labelled.select("bucket", "id", *more).join(chosen.select("bucket", F.col("leader").alias("id")), ["bucket", "id"], "left_anti"), "buckets")
        leaders = min(MOST_LEADERS, 8 * leaders)
