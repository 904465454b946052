"""Hits: what a line layer finds, as an array column, so that all of them share one pass over a corpus's lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = {
    "rule_id": "string", "severity": "string", "column": "int", "length": "int", "message": "string", "explanation": "string", "fix": "string", "cwe": "string",
    "confidence": "string", "sink": "string", "analyzer": "string", "layer_ord": "int", "rule_ord": "int",
}
TYPE = f"array<struct<{','.join(f'{k}:{t}' for k, t in FIELDS.items())}>>"


def hit(**values) -> Column:
    """One hit; fields that aren't given are null, texts of advice empty."""
    given = {"explanation": "", "fix": "", "rule_ord": 0} | values
    column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(*[column(given.get(k)).cast(t).alias(k) for k, t in FIELDS.items()])


def none() -> Column:
    return F.array().cast(TYPE)


def explode_hits(rows: DataFrame, found: Column) -> DataFrame:
    """A finding for each hit, with the columns of ``rows`` (lines of files) beside it."""
    kept = [c for c in rows.columns if c != "raw_line" and not c.startswith("__")]
    null = F.lit(None).cast("string")
    rows = rows.withColumn("__h", F.explode(found))
    return rows.select(*kept, "__h.*", null.alias("source"), null.alias("dataflow_path"))
