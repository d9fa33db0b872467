"""Content-addressed definitions, their differences, and invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def revision_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, change) of definitions (name, hash): added, removed or changed."""
    a, b = old.select("name", F.col("hash").alias("was")), new.select("name", F.col("hash").alias("now"))
    d = a.join(b, "name", "full").withColumn("change", F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed"))
    return d.where("change is not null").select("name", "change")


def invariant(rows: DataFrame, name: str, holds: str) -> DataFrame:
    """(invariant, violations): rows for which the condition isn't true."""
    return rows.agg(F.count_if(~F.coalesce(F.expr(holds), F.lit(False))).alias("violations")).select(F.lit(name).alias("invariant"), "violations")
