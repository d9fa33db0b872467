"""Definitions and evaluation cases out to JSON lines, and definitions back in."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonx
from .inputs import bounded

_WATCH = {"type": "object", "required": ["name", "source", "task"], "properties": {"name": {"type": "string", "minLength": 1}, "source": {"type": "object"}, "task": {"type": "object"}, "version": {"type": "integer"}}, "additionalProperties": False}


def exported_cases(cases: DataFrame, max_rows: int, *columns: str) -> DataFrame:
    """(line): a case as one canonical JSON text each; more cases than max_rows are refused, not cut."""
    body = F.to_json(F.struct(*(F.col(c) for c in columns)), {"ignoreNullFields": "false"})
    return bounded(cases, max_rows).select(jsonx.canonical_text(body).alias("line"))


def exported_watch(spark: SparkSession, definition: dict) -> DataFrame:
    """(name, definition, hash) of a definition: its canonical text and what names it."""
    text = jsonx.canonical(jsonx.loads(json.dumps(definition)))
    return spark.createDataFrame([(definition["name"], text)], "name string, definition string").withColumn("hash", F.sha2("definition", 256))


def imported_watches(texts: DataFrame, known: DataFrame, replace: bool = False) -> DataFrame:
    """(name, definition, hash, outcome) of definitions (text): created, unchanged, replaced, conflict (known and not to be replaced) or, with nothing else, why it isn't one."""
    t = texts.select("text", jsonx.schema_error(F.col("text"), _WATCH).alias("error"), jsonx.canonical_text(F.col("text")).alias("definition"))
    t = t.select("error", "definition", F.get_json_object("definition", "$.name").alias("name"), F.sha2("definition", 256).alias("hash"))
    d = t.join(known.select("name", F.col("hash").alias("was")), "name", "left")
    outcome = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("was").isNull(), "created").when(F.col("was") == F.col("hash"), "unchanged").otherwise("replaced" if replace else "conflict")
    return d.select("name", "definition", "hash", outcome.alias("outcome"))
