"""Content-addressed identity: canonical JSON text and its hashes, as column expressions."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMAT = "evidentia.identity.v1"
PREFIX = "evidentia:v1:sha256:"


def json_string(c: Column) -> Column:
    """A string as JSON text, escaped as jsonx.canonical does; null is the JSON null."""
    text = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    # Control characters are rare: one test passes a text without any by.
    names = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}
    full = text
    for k in range(32):
        full = F.replace(full, F.lit(chr(k)), F.lit(names.get(k, f"\\u{k:04x}")))
    escaped = F.when(c.rlike(r"[\x00-\x1F]"), full).otherwise(text)
    return F.coalesce(F.concat(F.lit('"'), escaped, F.lit('"')), F.lit("null"))


def json_number(c: Column, scale: int = 6) -> Column:
    """A number as JSON text without trailing zeros: 1.50 is 1.5 and 1.0 is 1."""
    text = c.cast(f"decimal(30,{scale})").cast("string")
    return F.coalesce(F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", ""), F.lit("null"))


def json_object(**fields: Column) -> Column:
    """An object of values that are JSON text already, keys in bytewise order, no spaces; a null value is the JSON null."""
    parts = [F.concat(F.lit(f"{json.dumps(k, ensure_ascii=False)}:"), F.coalesce(fields[k].cast("string"), F.lit("null"))) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def text_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def identity_hash(kind: str, value: Column) -> Column:
    """Identity of canonical JSON text within a kind."""
    return F.concat(F.lit(PREFIX), text_hash(F.concat(F.lit(f'{{"format":"{FORMAT}","kind":"{kind}","value":'), value, F.lit("}"))))


def manifest_hash(value: Column, *order: str) -> Column:
    """Aggregate: hash of the group's values, each JSON text, as an array ordered by the given columns."""
    rows = F.array_sort(F.collect_list(F.struct(*order, value.alias("v"))))
    return text_hash(F.concat(F.lit("["), F.array_join(F.transform(rows, lambda r: r["v"]), ","), F.lit("]")))
