"""Sets of keys compared without gathering either."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def equal(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row (equal): whether both have the same distinct keys; nulls are no keys."""
    rest = lambda x, y: x.select(key).where(F.col(key).isNotNull()).join(y.select(key), key, "left_anti").limit(1)
    return rest(a, b).unionByName(rest(b, a)).agg((F.count("*") == 0).alias("equal"))
