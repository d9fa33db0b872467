"""Table functions for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import jsonx


class JsonPaths:
    """(path, kind) of every node of a JSON text; a null or malformed text has none."""

    def eval(self, text: str):
        if text is None:
            return
        try:
            found = jsonx.paths(jsonx.loads(text))
        except (ValueError, ArithmeticError, RecursionError):
            return
        yield from sorted(found)


def register(spark: SparkSession) -> None:
    """json_paths(text) for the session's SQL."""
    spark.udtf.register("json_paths", F.udtf(JsonPaths, returnType="path string, kind string"))
