"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash within each source, placed at a fractional rank in [0, 1) and cut into equal runs,
so every shard mirrors the mixture of sources and any two shards differ by one row at most.

No rank is counted in one task: a source is dealt into hash ranges, whose counts give offsets by a window over counts
only; the same is done for ranges of the fractional rank. A source with a third of all rows is therefore spread over
thousands of groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, read

SHARDS = 24
SEED = 20
#: Hash ranges of a source and ranges of the fractional rank (three hexadecimal digits).
RANGES = 4096


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns that an operator is about to add (names compare without case, as Spark's do)."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in {n.lower() for n in names}])


def occurrence(df: DataFrame, key: str, *order) -> DataFrame:
    """Add ``__occ``: 1 for the first row of an id, 2 for the next and so on, so that (id, ``__occ``) is unique."""
    return df.withColumn("__occ", F.row_number().over(W.partitionBy(key).orderBy(*order)))


def interleave(rows: DataFrame, shards: int, seed: int, key: str = "doc_id", source: str = "source") -> DataFrame:
    """Add ``shard`` (int, from 0) and ``slot`` (long, gapless from 0 in each shard).

    Null sources form a source of their own. A null id counts as the text 'null'; rows that repeat an id are ordered
    by all their other columns, so that equal rows only can change places. An empty input gives an empty result. Columns
    named ``shard`` or ``slot`` are replaced. Give it light rows: everything passed in is shuffled twice.
    """
    rows = without(rows, "shard", "slot")
    id_text = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    source_text = F.coalesce(F.concat(F.lit("v"), F.col(source).cast("string")), F.lit("n"))
    rows = rows.withColumn("__s", source_text).withColumn("__k", F.md5(F.concat(F.lit(f"{seed}:"), id_text)))
    rows = rows.withColumn("__b", F.substring("__k", 1, 3))
    ties = [F.col(f"`{c}`") for c, kind in rows.dtypes if not kind.startswith("map") and not c.startswith("__")]

    counts = rows.groupBy("__s", "__b").agg(F.count("*").alias("__c"))
    by = W.partitionBy("__s")
    counts = counts.select(
        "__s",
        "__b",
        (F.sum("__c").over(by.orderBy("__b")) - F.col("__c")).alias("__before"),
        F.sum("__c").over(by).alias("__n"),
    )
    shift = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), "__s")), 1, 8), 16, 10).cast("double") / (1 << 32)
    ranked = rows.join(counts, ["__s", "__b"]).withColumn(
        "__f",
        (F.col("__before") + F.row_number().over(W.partitionBy("__s", "__b").orderBy("__k", *ties)) - 1 + shift) / F.col("__n"),
    )
    ranked = cut(ranked.drop("__b", "__before", "__n").withColumn("__r", F.floor(F.col("__f") * RANGES).cast("int")))

    ranges = ranked.groupBy("__r").agg(F.count("*").alias("__c"))
    one = W.partitionBy(F.lit(0))
    ranges = ranges.select(
        "__r", (F.sum("__c").over(one.orderBy("__r")) - F.col("__c")).alias("__before"), F.sum("__c").over(one).alias("__n")
    )
    placed = ranked.join(F.broadcast(ranges), "__r").withColumn(  # RANGES rows at most
        "__at", F.col("__before") + F.row_number().over(W.partitionBy("__r").orderBy("__f", "__k", *ties)) - 1
    )
    placed = placed.withColumn("shard", F.expr(f"cast((__at * {shards}) div __n as int)"))
    placed = placed.withColumn("slot", F.expr(f"__at - ((shard * __n + {shards - 1}) div {shards})"))
    return placed.drop("__s", "__k", "__f", "__r", "__before", "__n", "__at")


def measured(docs: DataFrame) -> DataFrame:
    """The light rows: doc_id, source, size (UTF-8 bytes plus 8) and crc32 of the text; a null text has no bytes."""
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return docs.select("doc_id", "source", (F.octet_length(raw) + F.lit(8)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = interleave(measured(read(spark, sf_dir, "documents")), SHARDS, SEED)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__crc`` and ``__size`` of the text, which order the rows of a repeated id."""
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return docs.withColumn("__crc", F.crc32(raw)).withColumn("__size", F.octet_length(raw))


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``. The text travels once, in the join that brings the places back."""
    rows, order = fingerprints(without(docs, "shard", "slot")), ["source", "__crc", "__size"]
    light = occurrence(rows.select("doc_id", *order), "doc_id", *order).select("doc_id", "source", F.col("__occ").alias("occ"))
    places = interleave(light, shards, seed).select(F.col("doc_id").alias("__id"), F.col("occ").alias("__o"), "shard", "slot")
    full = occurrence(rows, "doc_id", *order)
    return full.join(places, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__occ") == F.col("__o"))).drop("__id", "__o", "__occ", "__crc", "__size")


SQL_SHARDING = f"""
WITH crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM (SELECT unnest(range(256)) AS i))),
light AS (
  SELECT doc_id, source, coalesce(text, '') AS body, 'v' || source AS vs, md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS k FROM documents),
summed AS (
  SELECT light.*, strlen(body) + 8 AS size,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(regexp_replace(hex(encode(body)), '(..)', '\\1,', 'g'), ',')[1:strlen(body)], lambda h: ('0x' || h)::BIGINT)),
      lambda c, b: xor(c >> 8, crc_table.t[(xor(c, b) & 255) + 1])), 4294967295) AS crc
  FROM light, crc_table),
ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY source ORDER BY k, doc_id) - 1
      + ('0x' || substr(md5('{SEED}:' || coalesce(vs, 'n')), 1, 8))::BIGINT::DOUBLE / 4294967296) / count(*) OVER (PARTITION BY source) AS f FROM summed),
placed AS (SELECT *, row_number() OVER (ORDER BY f, k, doc_id) - 1 AS p, count(*) OVER () AS n FROM ranked)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'rows' AS law, ((p * {SHARDS}) // n)::INTEGER AS shard,
  (p - ((((p * {SHARDS}) // n) * n + {SHARDS - 1}) // {SHARDS}))::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM placed
"""
