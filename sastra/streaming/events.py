"""Streaming forms: scans of changed files, event ingestion and event sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.sessions import candidates


def latest(changes: DataFrame, key: str = "file_path", order: str = "ts", *rest: str) -> DataFrame:
    """STR-1: the last version of each file of a batch. Order is by time, then by the columns themselves."""
    rest = rest or tuple(c for c in changes.columns if c not in (key, order))
    return changes.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("x")).select(key, "x.*")


def scan_changes(changes: DataFrame, scan: Callable[[DataFrame], DataFrame], save: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """STR-1..4: each micro-batch is a debounce: the latest version of each changed file is scanned and its findings replace the old ones (``save``).

    ``scan`` is called for every batch, so it may reread rules.
    """

    def work(batch: DataFrame, number: int) -> None:
        save(scan(latest(batch)), number)

    writer = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(work)
    return (writer.trigger(availableNow=True) if once else writer).start()


def replacing(path: str) -> Callable[[DataFrame, int], None]:
    """STR-3: a ``save`` for :func:`scan_changes` that keeps findings below ``path`` by batch; :func:`current` shows each file's last ones. A batch that runs again replaces itself."""

    def save(found: DataFrame, number: int) -> None:
        found.write.mode("overwrite").parquet(f"{path}/findings/batch={number}")

    return save


def current(spark: SparkSession, path: str, files: DataFrame | None = None) -> DataFrame:
    """STR-3: the findings of each file's last batch. ``files`` (file_path, batch) says when files were scanned; without it a file that lost all its findings keeps the old ones."""
    found = spark.read.parquet(f"{path}/findings")
    last = (files or found).groupBy("file_path").agg(F.max("batch").alias("batch"))
    return found.join(last, ["file_path", "batch"])


def watch(changes: DataFrame, path: str, checkpoint: str, rules_path: str | None = None, once: bool = True, **options) -> StreamingQuery:
    """STR-1..4: changed files are scanned as they come, their findings replace the old ones below ``path``, and the rules at ``rules_path`` are read again for each batch."""
    from ..plans.scan import scan
    from ..sources.corpus import load_rules

    keep = replacing(path)

    def work(batch: DataFrame, number: int) -> None:
        files = latest(batch)
        files.select("file_path").write.mode("overwrite").parquet(f"{path}/files/batch={number}")
        custom = load_rules(batch.sparkSession, rules_path, "customPatterns") if rules_path else ()
        keep(scan(files, custom=custom, **options), number)

    writer = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(work)
    return (writer.trigger(availableNow=True) if once else writer).start()


def ingest(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """STR-5: candidate rules from a stream of events, each proposed rule once within the watermark."""
    return candidates(events.withWatermark("ts", delay)).dropDuplicatesWithinWatermark(["proposed_type"])


def tumbling(events: DataFrame, width: str = "1 hour", delay: str | None = None) -> DataFrame:
    """Events by type and window; with ``delay`` late ones are dropped after the watermark."""
    rows = events.withWatermark("ts", delay) if delay else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def attacker_sessions(events: DataFrame, gap: str = "30 minutes", delay: str | None = None) -> DataFrame:
    """Events as sessions by user: errors are failed logins, purchases and clicks are commands."""
    rows = events.withWatermark("ts", delay) if delay else events
    out = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(
        F.count("*").alias("events"),
        F.count_if(F.col("event_type") == "error").alias("failed"),
        F.count_if(F.col("event_type").isin("purchase", "click")).alias("commands"),
        F.min("ts").alias("first"),
        F.max("ts").alias("last"),
    )
    return out.select("user_id", "first", "last", "events", "failed", "commands")


def read_files(spark: SparkSession, path: str, schema: str, per_batch: int = 100) -> DataFrame:
    """STR-2: a file stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)
