"""Attacker sessions: triage, classes, techniques, and rules learned from events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lookup

# Techniques by class; command words of droppers.
TECHNIQUE = {"scanner": "T1046", "brute_forcer": "T1110", "interactive_attacker": "T1059", "ransomware_dropper": "T1204.002", "script_based_attacker": "T1059.006"}
DROPPER = ("wget", "curl", "chmod +x", "./", "chmod 777")
CONFIDENCE = 0.85
SESSION = "src_ip string, duration int, commands array<string>, downloads array<string>, login_attempts array<struct<success:boolean>>"
EVENT = ("src_ip", "honeypot_type", "geo", "commands", "payload_hash")


def failed_logins(attempts: Column) -> Column:
    """AGG-12: attempts that aren't marked as successes."""
    return F.coalesce(F.size(F.filter(attempts, lambda a: ~F.coalesce(a["success"], F.lit(False)))), F.lit(0))


def attacker_class(sessions: DataFrame) -> DataFrame:
    """SCO-10, SCO-13, JOIN-6: adds attacker_class, ttp and confidence by rules."""
    commands = F.coalesce("commands", F.array().cast("array<string>"))
    text = F.lower(F.array_join(commands, " "))
    drops = F.lit(False)
    for w in DROPPER:
        drops = drops | text.contains(w)
    n, duration = F.size(commands), F.coalesce("duration", F.lit(0))
    failed = F.when(F.col("login_attempts").isNull(), 0).otherwise(failed_logins(F.col("login_attempts")))
    kind = (
        F.when((duration == 0) & (n == 0), "scanner").when(failed > 10, "brute_forcer")
        .when((duration > 30) & (n > 0) & drops, "ransomware_dropper").when((duration > 30) & (n > 0), "interactive_attacker")
        .when(n > 0, "script_based_attacker").otherwise("scanner")
    )
    return sessions.withColumn("attacker_class", kind).withColumn("ttp", lookup(F.col("attacker_class"), TECHNIQUE, "T1046")).withColumn("confidence", F.lit(CONFIDENCE))


def triage(sessions: DataFrame) -> DataFrame:
    """SCO-14: threats are sessions of three commands or a login; the rest are scanners."""
    n = F.when(F.col("commands").isNull(), 0).otherwise(F.size("commands"))
    logins = F.when(F.col("login_attempts").isNull(), 0).otherwise(F.size("login_attempts"))
    return sessions.withColumn("verdict", F.when((n >= 3) | (logins >= 1), "threat").otherwise("scanner"))


def prefix(commands: Column, n: int = 10) -> Column:
    """LIM-3."""
    return F.slice(commands, 1, n)


def phishing(content: Column) -> Column:
    """SCO-11: (is_phishing, confidence) by words."""
    x = F.lower(content)
    return F.struct((x.contains("phish") | x.contains("login")).alias("is_phishing"), F.lit(0.5).alias("confidence"), F.lit("unknown").alias("technique"))


def cve_default() -> Column:
    """SCO-12: what is said of a weakness report without a model."""
    return F.struct(F.lit(False).alias("exploited_in_wild"), F.lit(5).alias("difficulty"), F.lit("network").alias("attack_vector"), F.lit(False).alias("kev"))


# Learned rules, in order: type, pattern, severity, languages, confidence, weakness, command words.
LEARNED = (
    ("Learned: SQL Injection (attacker-observed)", r"""(?:execute|query|raw)\s*\(\s*[`'"](?:SELECT|INSERT|UPDATE|DELETE)""", "critical", ("javascript", "typescript", "python", "java", "php", "go", "ruby"), 0.85, "CWE-89", ("sqlmap", "sql")),
    ("Learned: Credential Exposure (attacker-observed)", r"""(?:password|secret|token|key|api[_-]?key)\s*[:=]\s*[`'"][^`'"]{8,}[`'"]""", "critical", ("*",), 0.80, "CWE-798", ("cat .env", "credentials")),
    ("Learned: Command Injection (attacker-observed)", r"(?:exec|spawn|system|popen|subprocess)\s*\(\s*[^)]*\+[^)]*\)", "critical", ("javascript", "typescript", "python", "ruby", "go"), 0.75, "CWE-78", ("cmd", "exec")),
    ("Learned: Path Traversal (attacker-observed)", r"(?:readFile|open|require)\s*\(\s*[^)]*\.\.\/[^)]*\)", "high", ("javascript", "typescript", "python", "ruby"), 0.70, "CWE-22", ("/etc/passwd", "../")),
)


def candidates(events: DataFrame, least: float = 0.6) -> DataFrame:
    """INT-1, INT-2: events with commands and a weakness or tactics, with the rule they suggest. Works on batches and streams."""
    gated = events.where((F.size("commands") > 0) & (F.col("cwe").isNotNull() | F.col("matched_tactics").isNotNull()))
    text = F.lower(F.array_join("commands", " "))
    out = None
    for kind, regex, severity, languages, confidence, cwe, words in LEARNED:
        fits = F.coalesce(F.col("cwe") == cwe, F.lit(False))
        for w in words:
            fits = fits | text.contains(w)
        value = F.struct(F.lit(kind).alias("proposed_type"), F.lit(regex).alias("proposed_regex"), F.lit(severity).alias("severity"), F.array(*[F.lit(x) for x in languages]).alias("languages"), F.lit(confidence).alias("confidence"), F.lit(cwe).alias("cwe"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    shown = F.array_join(F.slice("commands", 1, 3), ", ").alias("behavior")
    return gated.select(*[c for c in gated.columns if c not in ("cwe", "confidence", "severity")], shown, out.alias("__c")).where(F.col("__c.confidence") >= least).select("*", "__c.*").drop("__c")


def by_confidence(found: DataFrame, least: float) -> DataFrame:
    """FLT-13."""
    return found.where(F.col("confidence") >= least)


def drop_approved(found: DataFrame, approved: DataFrame) -> DataFrame:
    """JOIN-9."""
    return found.join(approved.select("proposed_type").distinct(), "proposed_type", "left_anti")


def candidate_summary(found: DataFrame) -> DataFrame:
    """AGG-5: candidates by severity, and in all (null severity)."""
    return found.rollup("severity").agg(F.count("*").alias("n"))


def unify(*adapters: DataFrame) -> DataFrame:
    """SRC-10: rows of several producers as one event table; what one lacks is null."""
    out = None
    for a in adapters:
        out = a if out is None else out.unionByName(a, allowMissingColumns=True)
    return out.select(*[c for c in EVENT if c in out.columns], *[F.lit(None).cast("string").alias(c) for c in EVENT if c not in out.columns])
