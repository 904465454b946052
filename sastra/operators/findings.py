"""The findings relation: union, dedup, rank, filters, gates, aggregates, drift and clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lineage import numbered
from ..functions.text import REPORT_RANK, is_test_path, lookup, severity_rank

COLUMNS = ("rule_id", "severity", "file_path", "line", "column", "length", "message", "explanation", "fix", "cwe", "confidence", "source", "sink", "dataflow_path", "analyzer")
#: What the plan carries besides, for order and scoring.
CARRIED = ("layer_ord", "rule_ord", "line_text")
KEY = ("rule_id", "file_path", "line")
# Severities that each environment looks at (FLT-5).
ENVIRONMENTS = {"dev": ("critical", "high", "medium", "low"), "staging": ("critical", "high"), "prod": ("critical",)}


def union_layers(*layers: DataFrame) -> DataFrame:
    """SET-1: all layers as one bag with the finding schema; a layer's missing columns become null."""
    wanted = [*COLUMNS, *CARRIED]
    out = None
    for layer in layers:
        have = set(layer.columns)
        part = layer.select(*[F.col(f"`{c}`") if c in have else F.lit(None).cast("string").alias(c) for c in wanted])
        out = part if out is None else out.unionByName(part)
    return out


def dedup(findings: DataFrame) -> DataFrame:
    """DED-1: the first finding of each (rule, file, line) in the order of layers, rules and columns. One shuffle; the winner doesn't depend on partitions."""
    order = W.partitionBy(*KEY).orderBy("layer_ord", "rule_ord", "column", "length", "message")
    return findings.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def dedup_editor(findings: DataFrame) -> DataFrame:
    """DED-2: the last value of each (file, line, column, rule), as an editor's map keeps it."""
    order = W.partitionBy("file_path", "line", "column", "rule_id").orderBy(F.desc("layer_ord"), F.desc("rule_ord"), F.desc("length"), F.desc("message"))
    return findings.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def rank(findings: DataFrame) -> DataFrame:
    """SRT-1: by severity, then file, line, layer and rule."""
    return findings.orderBy(severity_rank(F.col("severity")), "file_path", "line", "layer_ord", "rule_ord", "column")


def filter_severity(findings: DataFrame, severities: Sequence[str] | None) -> DataFrame:
    return findings if severities is None else findings.where(F.col("severity").isin(*severities))


def gate(environment: str, severities: Sequence[str] | None = None) -> Sequence[str] | None:
    """FLT-5: the severities to look at; explicit ones win, an unknown environment looks at all."""
    return severities if severities else ENVIRONMENTS.get(environment)


def fails(findings: DataFrame, threshold: str) -> bool:
    """FLT-6: is any finding at least as severe as the threshold? Stops at the first."""
    return not findings.where(fails_at(F.col("severity"), threshold)).limit(1).isEmpty()


def fails_at(severity: Column, threshold: str) -> Column:
    return severity_rank(severity, REPORT_RANK) <= REPORT_RANK.get(threshold, 9)


def exclude_paths(findings: DataFrame, parts: Sequence[str]) -> DataFrame:
    """FLT-7: drop findings whose path holds any of the parts (plain text, not globs)."""
    if not parts:
        return findings
    path = F.replace("file_path", F.lit("\\"), F.lit("/"))
    return findings.where(~F.exists(F.array(*[F.lit(p) for p in parts]), lambda p: F.contains(path, p)))


def override_severity(findings: DataFrame, table: dict[str, str]) -> DataFrame:
    """FLT-9: severities by rule."""
    return findings.withColumn("severity", lookup(F.col("rule_id"), table, F.col("severity"))) if table else findings


def suppress(findings: DataFrame, table: dict[str, Sequence[str]]) -> DataFrame:
    """FLT-8: drop a rule's findings in files whose path holds any of its parts."""
    if not table:
        return findings
    pairs = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*[F.lit(p) for p in v]))])
    return findings.where(~F.coalesce(F.exists(F.try_element_at(pairs, F.col("rule_id")), lambda p: F.contains(F.col("file_path"), p)), F.lit(False)))


def deep_gate(files: DataFrame, findings: DataFrame, most_lines: int = 1000) -> DataFrame:
    """FLT-10, FLT-11: (file_path) of files worth a deeper look: suspicious words, any critical finding or more than three, and not too long."""
    words = r"(?i)(eval\s*\(|exec\s*\(|innerHTML|password|secret|token)"
    per_file = findings.groupBy("file_path").agg(F.count("*").alias("n"), F.max((F.col("severity") == "critical").cast("int")).alias("any_critical"))
    rows = files.select("file_path", F.col("content").rlike(words).alias("suspicious"), F.size(F.split("content", "\n", -1)).alias("lines")).join(per_file, "file_path", "left")
    return rows.where((F.col("suspicious") | (F.col("any_critical") == 1) | (F.col("n") > 3)) & (F.col("lines") <= most_lines)).select("file_path")


# ---------------------------------------------------------------- aggregates


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("n")).orderBy("severity")


def in_order(findings: DataFrame) -> DataFrame:
    """Findings, most severe first, with ``at`` (the place of all, from 1), ``n`` (the size of its severity's group) and ``nth`` (the place in it).

    A group may hold most findings, so no window holds one: places come from a range-partitioned numbering, less the groups before.
    """
    rows = numbered(findings.withColumn("__rank", severity_rank(F.col("severity"), REPORT_RANK)), "__rank", "severity", "file_path", "line", "column", "rule_id", "message", name="at").drop("__rank")
    sizes = rows.groupBy("severity").agg(F.count("*").alias("n"))  # of the numbered rows, so that the scan behind the findings runs once
    before = F.sum("n").over(W.partitionBy(F.lit(0)).orderBy(severity_rank(F.col("severity"), REPORT_RANK), "severity")) - F.col("n")  # one row a severity
    sizes = sizes.select(F.col("severity").alias("__s"), "n", before.alias("__before"))
    rows = rows.join(F.broadcast(sizes), F.col("severity").eqNullSafe(F.col("__s")))  # one row a severity
    return rows.withColumn("nth", F.col("at") - F.col("__before")).drop("__s", "__before")


def grouped(findings: DataFrame) -> DataFrame:
    """AGG-2: findings by severity, most severe first: ``n`` (the size of the group), ``nth`` (the place in it, from 1) and the finding. Groups stay rows, whatever their size."""
    return in_order(findings.select("severity", "file_path", "line", "column", "rule_id", "message", "cwe", "fix")).drop("at")


def catalog_stats(rules: DataFrame) -> DataFrame:
    """AGG-4: the number of rules and the languages they name, '*' aside."""
    names = F.array_sort(F.array_remove(F.array_distinct(F.flatten(F.collect_list("languages"))), "*"))
    return rules.agg(F.count("*").alias("rules"), names.alias("languages"))


def top_words(rows: DataFrame, word: str, n: int) -> DataFrame:
    """AGG-6: the ``n`` most frequent values; ties by value."""
    return rows.groupBy(word).agg(F.count("*").alias("n")).orderBy(F.desc("n"), word).limit(n)


def totals(findings: DataFrame) -> DataFrame:
    """AGG-11: tests and failures of a CI report."""
    return findings.agg(F.count("*").alias("tests"), F.count_if(F.col("severity").isin("critical", "high")).alias("failures"))


def top_findings(findings: DataFrame, n: int = 5) -> DataFrame:
    """LIM-1: the first critical and high findings."""
    return rank(findings.where(F.col("severity").isin("critical", "high"))).limit(n)


# ---------------------------------------------------------------- drift and clusters


def drift_new(current: DataFrame, previous: DataFrame) -> DataFrame:
    """SET-2: findings of the current scan that the previous one lacks."""
    return current.join(previous.select(*KEY), list(KEY), "left_anti")


def drift_resolved(current: DataFrame, previous: DataFrame) -> DataFrame:
    """SET-3: findings of the previous scan that are gone."""
    return drift_new(previous, current)


def drift_persisting(current: DataFrame, previous: DataFrame) -> DataFrame:
    return current.join(previous.select(*KEY), list(KEY), "left_semi")


def regressions(current: DataFrame, previous: DataFrame, older: DataFrame) -> DataFrame:
    """DOC-3: findings that were gone in the previous scan and are back."""
    return drift_new(current, previous).join(older.select(*KEY), list(KEY), "left_semi")


def systemic(lines: DataFrame, least: int = 2, repo: str = "repo", path: str = "file_path", text: str = "line_text") -> DataFrame:
    """AGG-9: the same line in several repositories: (fingerprint, repos, files). Distinct pairs meet first, so a line in a third of all files stays small."""
    mark = F.sha2(F.trim(F.lower(text)), 256).alias("fingerprint")
    pairs = lines.select(mark, F.col(repo).alias("repo"), F.col(path).alias("path"))
    repos = pairs.select("fingerprint", "repo").distinct().groupBy("fingerprint").agg(F.count("repo").alias("repos")).where(F.col("repos") >= least)
    files = pairs.select("fingerprint", "path").distinct().groupBy("fingerprint").agg(F.count("path").alias("files"))
    return repos.join(files, "fingerprint")


def fingerprint(findings: DataFrame) -> DataFrame:
    """DOC-2: a stable id of a finding."""
    parts = F.concat_ws("\u0001", "file_path", F.col("line").cast("string"), "rule_id")
    return findings.withColumn("fingerprint", F.sha2(parts, 256))


def composite_priority(findings: DataFrame, signals: Sequence[str], most: int = 2) -> DataFrame:
    """DOC-1: the severity rank raised by the number of true signals, by ``most`` at most and not above critical."""
    up = sum((F.coalesce(F.col(s), F.lit(False)).cast("int") for s in signals), F.lit(0))
    return findings.withColumn("priority", F.greatest(severity_rank(F.col("severity")) - F.least(up, F.lit(most)), F.lit(0)))


def root_causes(findings: DataFrame) -> DataFrame:
    """DOC-3: findings by weakness and directory."""
    folder = F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1).alias("directory")
    return findings.groupBy("cwe", folder).agg(F.count("*").alias("n"))


def anomalies(history: DataFrame, current: DataFrame, key: str = "repo", least: float = 3.0) -> DataFrame:
    """DOC-3: (key, n, mean, deviation, score, anomalous): a scan's count against the (key, n) counts of earlier scans.

    The score is the distance from their mean in standard deviations; counts that never varied make any change anomalous. A key without history has no score and isn't anomalous.
    A score that is ``least`` but for rounding falls on one side or the other with the order of additions, so a key's counts (one number a scan) are added in
    ascending order: equal counts get equal answers.
    """

    def add(state, x):
        gap = x - state["mean"]
        mean = state["mean"] + gap / (state["count"] + 1)
        return F.struct((state["count"] + 1).alias("count"), mean.alias("mean"), (state["squares"] + (x - mean) * gap).alias("squares"))

    start = F.struct(F.lit(0.0).alias("count"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))
    deviation = lambda counts: F.aggregate(F.array_sort(counts), start, add, lambda s: F.when(s["count"] > 0, F.sqrt(s["squares"] / s["count"])))
    base = history.groupBy(key).agg(F.avg("n").alias("mean"), F.collect_list(F.col("n").cast("double")).alias("counts"))
    base = base.select(key, "mean", deviation(F.col("counts")).alias("deviation"))
    rows = current.select(key, "n").join(base, key, "left")
    gap = F.abs(F.col("n") - F.col("mean"))
    score = F.when(F.col("deviation") > 0, gap / F.col("deviation"))
    return rows.withColumn("score", score).withColumn("anomalous", F.coalesce(F.when(F.col("deviation") > 0, score >= least).otherwise(gap > 0), F.lit(False)))


# Ours: how exposed a path is, by words in it; the largest weight that fits counts, and tests weigh least.
SURFACE = (("auth", 1.5), ("login", 1.5), ("payment", 1.5), ("admin", 1.4), ("api", 1.3), ("route", 1.3), ("upload", 1.3), ("config", 1.2))
TEST_SURFACE = 0.3


def surface_weight(path: Column) -> Column:
    """DOC-3: the weight of a file's exposure, 1 for a path without any of the words."""
    low = F.lower(path)
    known = F.greatest(F.lit(1.0), F.lit(1.0), *[F.when(low.contains(word), F.lit(weight)).otherwise(1.0) for word, weight in SURFACE])
    return F.when(is_test_path(path), F.lit(TEST_SURFACE)).otherwise(known)


def learning_counts(events: DataFrame, tools: str = "tools") -> DataFrame:
    """DOC-6: (tool, events): how many events used each tool of their list; an event counts once a tool."""
    return events.select(F.explode(F.array_distinct(tools)).alias("tool")).where("tool is not null").groupBy("tool").agg(F.count("*").alias("events"))


def tenant_view(findings: DataFrame, tenant: str, column: str = "tenant") -> DataFrame:
    """FLT-14: one tenant's rows and no others."""
    return findings.where(F.col(column) == tenant)


def staged(files: DataFrame, changed: DataFrame, suffixes: Sequence[str] = (".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".php", ".go", ".rs")) -> DataFrame:
    """SRC-6: the files of a change list, of the suffixes that the commit hook looks at."""
    wanted = changed.where(F.lower("file_path").rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")).select("file_path").distinct()
    return files.join(wanted, "file_path", "left_semi")
