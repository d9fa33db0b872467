"""Actions that a judgment proposes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DECLARES = {"match": {"merge_candidate": "same_entity", "new_entity": "different_entity", "review_flag": "unclear"}, "decision": {"review_flag": "flag"}}


def declared_answer(kind: Column, field: str = "match") -> Column:
    """The answer that an action of this type amounts to in the answer field; null where it says nothing of it."""
    known = _DECLARES.get(field or "match", {})
    return F.coalesce(F.lit(None).cast("string"), *(F.when(kind == k, F.lit(v)) for k, v in known.items()))


def applied(rows: DataFrame, key: str, actions: DataFrame, allowed: list[str], done: DataFrame, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """(the next version of rows, report) of actions (action_id, idempotency_key, target, column, value, before_hash).

    An action changes one column of one row. It is refused if the column isn't on the list (column_not_allowed), its key was
    used before or by a lesser action (duplicate), the row is gone (row_missing), another action of the same cell comes
    first (superseded) or the cell is no longer what the action saw (changed); all others are applied. report: (action_id,
    outcome, before_hash, after_hash). A dry run leaves the rows as they are. Rows are never changed in place.
    """
    from pyspark.sql import Window

    text = lambda c: F.sha2(F.coalesce(c.cast("string"), F.lit("")), 256)
    cells = rows.select(F.col(key).cast("string").alias("target"), F.expr(f"stack({len(allowed)}, {', '.join(f'{c!r}, cast(`{c}` as string)' for c in allowed)}) as (column, now)"))
    a = actions.withColumn("nth", F.row_number().over(Window.partitionBy("idempotency_key").orderBy("action_id")))
    a = a.join(done.select("idempotency_key", F.lit(True).alias("used")).distinct(), "idempotency_key", "left").join(cells, ["target", "column"], "left").join(rows.select(F.col(key).cast("string").alias("target"), F.lit(True).alias("there")), "target", "left")
    early = (
        F.when(~F.col("column").isin(*allowed), "column_not_allowed").when(F.col("used") | (F.col("nth") > 1), "duplicate").when(F.col("there").isNull(), "row_missing")
        .when(F.col("before_hash") != text(F.col("now")), "changed")
    )
    a = a.withColumn("refused", early)
    first = Window.partitionBy("target", "column", F.col("refused").isNull()).orderBy("action_id")
    a = a.withColumn("outcome", F.when(F.col("refused").isNotNull(), F.col("refused")).when(F.row_number().over(first) > 1, "superseded").otherwise("applied"))
    report = a.select("action_id", "outcome", F.when(F.col("there") & F.col("column").isin(*allowed), text(F.col("now"))).alias("before_hash"), F.when(F.col("outcome") == "applied", text(F.col("value"))).alias("after_hash"))
    if dry_run:
        return rows, report
    new = a.where("outcome = 'applied'").groupBy(F.col("target").alias("_target")).agg(*(F.max(F.when(F.col("column") == c, F.struct(F.col("value").alias("v")))).alias(f"_{k}") for k, c in enumerate(allowed)))
    joined = rows.join(new, rows[key].cast("string") == F.col("_target"), "left")
    place = {c: k for k, c in enumerate(allowed)}
    return joined.select(*(F.when(F.col(f"_{place[c]}").isNotNull(), F.col(f"_{place[c]}.v").cast(rows.schema[c].dataType)).otherwise(rows[c]).alias(c) if c in place else rows[c] for c in rows.columns)), report
