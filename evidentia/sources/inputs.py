"""Rows and pairs as inputs of judgments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import identity_hash


def row_inputs(rows: DataFrame, key: str, content: Column, version: Column, contract: Column) -> DataFrame:
    """(subject_id, content, content_hash, contract_hash, source_hash); content is canonical JSON text, version the row's."""
    d = rows.select(F.col(key).cast("string").alias("subject_id"), content.alias("content"), version.alias("_version"), contract.alias("contract_hash"))
    source = F.concat(F.lit("["), F.col("content"), F.lit(","), F.col("_version"), F.lit("]"))
    return d.select("subject_id", "content", identity_hash("semantic_content", F.col("content")).alias("content_hash"), "contract_hash", identity_hash("semantic_source", source).alias("source_hash"))


#: Bytes of a table, as estimated, that one task of spread gets.
TASK_BYTES = 2 << 20


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows shuffled by the keys to as many tasks as their bytes ask for, the session's number of partitions at least: what a task sorts or counts by these keys doesn't grow with the table."""
    plan = rows._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    size = min(int(str(plan.stats().sizeInBytes())), sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())))  # after a join the plan's own estimate is a product
    parts = -(-size // TASK_BYTES) if size < 1 << 50 else 0  # beyond that it isn't known
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts), *keys)


#: Rows of a block that are paired with as many others in one piece.
CHUNK = 1000


def candidate_pairs(rows: DataFrame, key: str, *blocking: str, carried: tuple[str, ...] = ()) -> DataFrame:
    """(subject_id, left_id, right_id, left_x and right_x of each carried column x) of rows that agree on the blocking columns, the lesser key first: an equi join.

    A block of more than CHUNK rows is cut into chunks by hash, and each two chunks are joined apart, so that no task holds
    more than a chunk and one block's pairs are spread over all tasks. What pairs are judged by is carried along: a pair,
    of which there may be many more than rows, is shuffled by nobody.
    """
    large = rows.groupBy(*blocking).agg(F.count("*").alias("_n")).where(F.col("_n") > CHUNK)  # at most a row for every CHUNK
    sized = rows.select(F.col(key).alias("_id"), *blocking, *carried).join(F.broadcast(large), list(blocking), "left")
    chunks = F.coalesce(F.ceil(F.col("_n") / CHUNK), F.lit(1)).cast("int")
    d = sized.withColumn("_chunks", chunks).withColumn("_chunk", F.pmod(F.xxhash64("_id"), F.col("_chunks")).cast("int"))
    piece, columns = [*blocking, "_near", "_far"], ["_id", *carried]
    sc = rows.sparkSession.sparkContext
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * sc.defaultParallelism)  # a number that stays: few bytes of rows are many pairs

    def side(mark: str, near, far):
        return d.select(*blocking, near.alias("_near"), far.alias("_far"), *(F.col(c).alias(mark + c) for c in columns)).repartition(parts, *piece)

    every = F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))
    joined = side("left_", F.col("_chunk"), every).join(side("right_", every, F.col("_chunk")), piece).where("left__id < right__id")
    pairs = joined.select(F.col("left__id").alias("left_id"), F.col("right__id").alias("right_id"), *(f"{s}_{c}" for s in ("left", "right") for c in carried))
    return pairs.select(F.concat_ws(":", F.col("left_id").cast("string"), F.col("right_id").cast("string")).alias("subject_id"), *pairs.columns)


def bounded(rows: DataFrame, cap: int) -> DataFrame:
    """rows, if there are no more than cap: a larger set is refused rather than cut."""
    if rows.limit(cap + 1).count() > cap:
        raise ValueError(f"more than {cap} rows")
    return rows


def field_allowed(fields: Column, allowed: list[str] | None) -> Column:
    """Whether every field is on the list; without a list only no field at all is."""
    return F.size(fields) == 0 if allowed is None else F.forall(fields, lambda f: f.isin(*allowed))
