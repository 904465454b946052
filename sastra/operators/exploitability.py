"""Exploitability scores as column arithmetic, in the order of factors that the reported scores have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lookup, python_round

# Class, keywords (substrings of rule, message and weakness), base and greatest score, in match order.
CLASSES = (
    ("sql_injection", ("sql", "sqli", "injection", "cwe-89"), 5.0, 9.5),
    ("command_injection", ("command", "exec", "cwe-78", "rce"), 6.0, 10.0),
    ("xss", ("xss", "cross-site", "cwe-79"), 3.5, 7.5),
    ("deserialization", ("deserial", "pickle", "yaml", "cwe-502"), 6.0, 9.5),
    ("path_traversal", ("path traversal", "cwe-22", "directory traversal"), 4.0, 8.0),
    ("ssrf", ("ssrf", "cwe-918", "server-side request"), 4.0, 8.5),
    ("hardcoded_secret", ("secret", "cwe-798", "hardcoded"), 5.0, 9.0),
    ("buffer_overflow", ("buffer overflow", "cwe-120", "cwe-121", "strcpy"), 6.0, 9.5),
    ("use_after_free", ("use-after-free", "cwe-416", "uaf"), 6.0, 9.0),
)
GENERAL = ("general", 3.0, 7.0)
SEVERITY = {"critical": 1.5, "high": 1.2, "medium": 1.0, "low": 0.7, "info": 0.4}
VECTOR = {"Network": 1.3, "Adjacent": 1.0, "Local": 0.8, "Physical": 0.5}
PRIVILEGE = {"None": 1.0, "Authenticated": 0.6, "Admin": 0.3}
PUBLIC = "sql.*inject|command.*inject|xss|path.*traversal|buffer.*overflow|deserial|ssrf|rce"


def finding_class(strict: bool = False) -> Column:
    """SCO-1. ``strict`` matches weaknesses and 'rce' as whole words, so CWE-798 is no CWE-79 and 'source' no 'rce'."""
    text = F.lower(F.concat_ws(" ", "rule_id", "message", F.coalesce("cwe", F.lit(""))))
    out = None
    for name, words, base, most in CLASSES:
        fits = F.lit(False)
        for w in words:
            fits = fits | (text.rlike(rf"\b{w}\b") if strict and (w.startswith("cwe") or w == "rce") else text.contains(w))
        value = F.struct(F.lit(name).alias("name"), F.lit(base).alias("base"), F.lit(most).alias("most"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out.otherwise(F.struct(*[F.lit(x).alias(n) for x, n in zip(GENERAL, ("name", "base", "most"), strict=True)]))


def attack_vector(line: Column) -> Column:
    x = F.lower(F.coalesce(line, F.lit("")))
    return F.when(x.rlike("http|fetch|axios|request|socket|ws://|wss://"), "Network").when(x.rlike("file|path|open|read|write"), "Local").when(x.rlike("physical|usb|nfc|bluetooth"), "Physical").otherwise("Network")


def complexity(line: Column) -> Column:
    x = F.lower(F.coalesce(line, F.lit("")))
    add = lambda words, d: F.when(x.rlike(words), d).otherwise(0.0)
    return F.least(F.lit(0.3) + add("auth|login|token|session|cookie", 0.2) + add("csrf|nonce|captcha|challenge", 0.2) + add("rate.limit|timeout|retry|backoff", 0.1) + add("validate|sanitize|escape|filter", 0.3), F.lit(1.0))


def privileges(line: Column) -> Column:
    x = F.lower(F.coalesce(line, F.lit("")))
    return F.when(x.rlike("admin|root|sudo|superuser|privileged"), "Admin").when(x.rlike("user|authenticated|login|session"), "Authenticated").otherwise("None")


def discoverability(line: Column) -> Column:
    x = F.lower(F.coalesce(line, F.lit("")))
    add = lambda words, d: F.when(x.rlike(words), d).otherwise(0.0)
    return F.least(F.lit(0.5) + add(r"public|api|route|endpoint|exposed|open|/\w+/\w+", 0.3) + add("debug|test|dev|staging|local", 0.2) + add("param|query|body|input|user", 0.2), F.lit(1.0))


def public_exploit() -> Column:
    return F.lower(F.concat_ws(" ", "rule_id", F.coalesce("cwe", F.lit("")))).rlike(PUBLIC)


def score(findings: DataFrame, line: str = "line_text", strict: bool = False) -> DataFrame:
    """SCO-7: adds class, vector, privileges, public_exploit, exploitability_score (one decimal) and exploitability_label."""
    text = F.col(line)
    rows = findings.withColumns({"__class": finding_class(strict), "attack_vector": attack_vector(text), "auth_required": privileges(text), "public_exploit": public_exploit()})
    severity = lookup(F.lower(F.coalesce("severity", F.lit("medium"))), SEVERITY, 1.0)
    sure = lookup(F.lower(F.coalesce("confidence", F.lit("medium"))), {"high": 1.2, "medium": 1.0}, 0.7)
    raw = (
        F.col("__class.base") * severity * sure * lookup(F.col("attack_vector"), VECTOR, 1.0) * lookup(F.col("auth_required"), PRIVILEGE, 1.0)
        * (F.lit(1.0) - complexity(text) * 0.4) * (F.lit(1.0) + discoverability(text) * 0.3) * F.when(F.col("public_exploit"), 1.5).otherwise(1.0)
    )
    rows = rows.withColumn("exploitability_score", python_round(F.greatest(F.lit(0.0), F.least(raw, F.col("__class.most"))), 1))
    s = F.col("exploitability_score")
    label = F.when(s >= 7, "Critical").when(s >= 4, "High").when(s >= 2, "Medium").otherwise("Low")
    return rows.withColumn("exploitability_label", label).withColumn("exploit_class", F.col("__class.name")).drop("__class")


def summary(scored: DataFrame) -> DataFrame:
    """AGG-3: average (one decimal), greatest score, number from 7.0 up, total; zeros without findings."""
    s = F.col("exploitability_score")
    return scored.agg(
        F.coalesce(python_round(F.avg(s), 1), F.lit(0.0)).alias("average"), F.coalesce(F.max(s), F.lit(0.0)).alias("max"), F.count_if(s >= 7).alias("critical_count"), F.count("*").alias("total")
    )
