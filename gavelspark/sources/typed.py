"""Decoding typed values of any depth: documents whose every value is wrapped in a map that names its kind.

The payload is held as a VARIANT and walked level by level: each round unwraps the values at hand, keeps the plain ones
and explodes maps and arrays into the values of the next round. There are as many rounds as the deepest document has
levels; every row takes part in as many as it is deep. What comes out is a row for each plain value with its path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.stable import pinned

#: The kinds of plain values, and what their text is read as.
KINDS = {"stringValue": "string", "integerValue": "bigint", "doubleValue": "double", "booleanValue": "boolean", "timestampValue": "string", "nullValue": "string"}


def _plain(value: Column) -> tuple[Column, Column]:
    """(kind, text) of a wrapped plain value; kind is null for anything else."""
    kind = text = F.lit(None).cast("string")
    for name, read in reversed(KINDS.items()):
        held = F.try_variant_get(value, f"$.{name}", "string")
        own = F.try_variant_get(value, f"$.{name}", read).cast("string") if name != "integerValue" else held.try_cast("bigint").cast("string")
        present = held.isNotNull() if name != "nullValue" else F.to_json(value).startswith('{"nullValue"')
        kind, text = F.when(present, name).otherwise(kind), F.when(present, own if name != "nullValue" else F.lit(None).cast("string")).otherwise(text)
    return kind, text


def typed_values(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, path, kind, value) of every plain value under the fields of a document (JSON text of a map from names to
    wrapped values). Paths join names by dots and number the members of arrays from 0 in brackets. Empty maps and arrays
    and values of no known kind give no row."""
    explode = lambda column: rows.sparkSession.tvf.variant_explode(F.col(column).outer())
    docs = rows.select(F.col(key).alias("__id"), F.try_parse_json(payload).alias("inner"))
    level = docs.lateralJoin(explode("inner")).select("__id", F.col("key").alias("path"), F.col("value").alias("v"))
    out = None
    while True:
        level = pinned(level)
        kind, text = _plain(F.col("v"))
        plain = level.select("__id", "path", kind.alias("kind"), text.alias("value")).filter("kind IS NOT NULL")
        out = plain if out is None else out.unionByName(plain)
        if level.isEmpty():
            return out.withColumnRenamed("__id", key)
        inner = F.coalesce(*[F.try_variant_get("v", path, "variant") for path in ("$.mapValue.fields", "$.arrayValue.values")])
        held = level.withColumn("inner", inner).filter("inner IS NOT NULL").drop("v")
        # members of arrays have no name; one branch for both, so that a level has no more partitions than the last
        step = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), "key")).otherwise(F.concat(F.lit("["), "pos", F.lit("]")))
        level = held.lateralJoin(explode("inner")).select("__id", F.concat("path", step).alias("path"), F.col("value").alias("v"))
