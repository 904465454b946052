"""Sources: directories, driver tables as corpora, rule catalogs, configurations, change lists and earlier scans."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import language_of
from ..operators.rules import Rule

# Suffixes that a directory scan keeps, and folders that it prunes.
SUFFIXES = (".py", ".js", ".ts", ".tsx", ".jsx", ".java", ".php", ".go", ".rs", ".cpp", ".cc", ".c", ".cs", ".rb", ".swift", ".kt")
PRUNED = ("node_modules", "__pycache__", "venv", ".git", "dist", "build", "vendor", ".venv", "env", "target", "out", "coverage")
WORKSPACE = "*.{js,ts,py,java,php}"
DEFAULTS = {"type": "unknown", "severity": "medium", "message": "", "explanation": "", "fix": ""}
DRIFT = "rule_id string, file_path string, line int, severity string, cwe string, message string"


def files_at(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """SRC-2: (file_path, content) of every file below ``path``; bytes that aren't UTF-8 are dropped."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return rows.select(F.col("path").alias("file_path"), F.replace(F.decode("content", "UTF-8"), F.lit("�"), F.lit("")).alias("content"))


def scan_directory(spark: SparkSession, path: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """SRC-1: source files below ``path`` in the kept suffixes, outside pruned and hidden folders, with their language.

    The path is judged below the scanned folder only, and the filters run on paths, before any content is read.
    """
    root = re.sub(r"^file:/*", "/", path).rstrip("/")
    rows = files_at(spark, path)
    below = F.regexp_replace("file_path", "^.*" + re.escape(root) + "/", "")
    steps = F.split(below, "/")
    folders = F.slice(steps, 1, F.size(steps) - 1)
    rows = rows.where(~F.exists(folders, lambda d: d.isin(*PRUNED, *exclude) | d.startswith(".")))
    rows = rows.where(F.lower("file_path").rlike("(" + "|".join(s.replace(".", r"\.") for s in SUFFIXES) + ")$"))
    return rows.withColumn("language", language_of(F.col("file_path")))


def workspace(spark: SparkSession, path: str) -> DataFrame:
    """SRC-7: the editor's file list."""
    return files_at(spark, path, WORKSPACE).withColumn("language", language_of(F.col("file_path")))


def from_documents(documents: DataFrame) -> DataFrame:
    """Documents as source files: repo = source, file_path = source/doc_id.txt, language = lang."""
    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return documents.select(path.alias("file_path"), F.col("source").alias("repo"), F.col("lang").alias("language"), F.col("text").alias("content"))


def from_pages(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("url").alias("file_path"), F.lit("web").alias("repo"), F.lit("html").alias("language"), F.col("html").alias("content"))


def sessions_of(conversations: DataFrame) -> DataFrame:
    """Conversations as attacker sessions: commands = what the user says by turn, duration = the last turn, no logins."""
    said = F.array_compact(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.when(x["role"] == "user", x["text"])))
    return conversations.groupBy("conv_id").agg(said.alias("commands"), F.max("turn").cast("int").alias("duration")).withColumn("login_attempts", F.array().cast("array<struct<success:boolean>>"))


def parse_rules(text: str, key: str = "patterns") -> tuple[Rule, ...]:
    """SRC-3, SRC-4: rules of a JSON catalog. Missing fields get their defaults; a pattern that doesn't compile is skipped."""
    out = []
    for p in json.loads(text).get(key, []):
        regex = p.get("regex")
        if not isinstance(regex, str):
            continue
        try:
            re.compile(regex)
        except re.error:
            continue
        field = {k: p.get(k, d) for k, d in DEFAULTS.items()}
        out.append(Rule(field["type"], field["severity"], regex, tuple(p.get("languages", ["*"])), p.get("cwe"), field["message"], field["explanation"], field["fix"]))
    return tuple(out)


def load_rules(spark: SparkSession, path: str, key: str = "patterns") -> tuple[Rule, ...]:
    """Rules of a JSON file anywhere that Spark reads; none if it is missing."""
    try:
        rows = spark.read.text(path, wholetext=True).collect()  # one configuration file
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return ()
        raise
    return tuple(r for row in rows for r in parse_rules(row["value"], key))


CONFIG = (
    "version string, rules array<string>, customPatterns array<struct<type:string,severity:string,regex:string,languages:array<string>,message:string,explanation:string,fix:string,cwe:string>>, "
    "severityOverrides map<string,string>, excludedPaths array<string>, suppressions map<string,array<string>>, sharedRules array<string>"
)


def load_config(spark: SparkSession, path: str) -> dict | None:
    """SRC-5: a workspace configuration as a dict, or None if it is missing or isn't one."""
    try:
        rows = spark.read.text(path, wholetext=True).select(F.from_json("value", CONFIG, {"mode": "FAILFAST"}).alias("c")).select("c.*").collect()  # one configuration file
    except Exception:
        return None
    return rows[0].asDict(recursive=True) if rows else None


def save_state(findings: DataFrame, path: str) -> None:
    """SNK-11: what the next scan compares itself with."""
    findings.select("rule_id", "file_path", "line", "severity", "cwe", "message").write.mode("overwrite").json(path)


def load_state(spark: SparkSession, path: str) -> DataFrame:
    """SRC-11."""
    return spark.read.schema(DRIFT).json(path)


def load_signals(spark: SparkSession, path: str) -> DataFrame:
    """SRC-9: the threat summary from a file; missing counts are 0."""
    rows = spark.read.schema("active_attackers long, bait_reads long, breach_hits long").json(path)
    return rows.fillna(0)


def signals_status(spark: SparkSession, path: str | None) -> str:
    """INT-7: 'not_configured' without a path, 'unreachable' if nothing can be read there, else 'ok'."""
    if not path:
        return "not_configured"
    try:
        load_signals(spark, path).limit(1).collect()
    except Exception:
        return "unreachable"
    return "ok"
