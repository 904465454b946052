"""Registered queries over the driver's tables, one for each operator family, with DuckDB SQL beside each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import entropy, explode_lines, is_test_path, language_of
from ..operators import calls, exploitability, findings, graph, heuristics, knowledge, python_ast, rules, sessions
from ..operators.rules import Rule
from ..sinks import reports
from ..sources import corpus
from ..streaming import events as streams
from . import scan as plans
from .snippets import APP, CALLS, LINES, PYTHON, sql_text, values

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Ours: custom rules for prose corpora, so that findings of every severity occur there.
PROSE = (
    Rule("Email Address", "medium", r"[a-z0-9._-]+@[a-z0-9-]+[.][a-z]{2,}", ("*",), "CWE-359", "Personal address", "It names a person who didn't ask to be in a corpus.", "Mask the address."),
    Rule("IPv4 Address", "low", r"[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}", ("*",), "CWE-200", "Network address"),
    Rule("Payment Card", "high", r"[0-9]{16}", ("*",), "CWE-311", "Card number", "Whoever reads it can pay with it.", "Remove the number."),
    Rule("License Line", "info", r"released under the", ("*",), None, "License notice"),
)
SECRET = rules.CATALOG[5]


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files. The driver's table may be one file, so it is dealt out before lines are split."""
    rows = corpus.from_documents(table(spark, sf_dir, "documents"))
    return rows.repartition(spark.sparkContext.defaultParallelism) if rows.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism else rows


def snippets(spark: SparkSession) -> DataFrame:
    rows = [(f"app/s{i}.{language}", language, line) for i, (language, line) in enumerate(LINES)]
    return spark.createDataFrame(rows, "file_path string, language string, content string")


def sample_files(spark: SparkSession) -> DataFrame:
    """All code samples as files, under the suffixes of their languages."""
    ends = {"javascript": "js", "rust": "rs", "typescript": "ts", "python": "py", "go": "go"}
    rows = [(f"app/s{i}.{ends.get(language, language)}", language, line) for i, (language, line) in enumerate(LINES)]
    rows += [(f"app/c{i}.{ends.get(language, language)}", language, text) for i, (language, text, _) in enumerate(CALLS)]
    return spark.createDataFrame([*rows, *((p, "python", c) for p, c in PYTHON)], "file_path string, language string, content string")


def prose_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique findings over documents: the secret rule and the prose rules."""
    return findings.dedup(findings.union_layers(rules.line_findings(documents(spark, sf_dir), rules=(SECRET,), custom=PROSE)))


# ---------------------------------------------------------------- SQL pieces

_RULES = (SECRET, *PROSE)
_SQL_LINES = """d AS (SELECT coalesce(source, 'none') || '/' || doc_id || '.txt' AS file_path, source AS repo, lang, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS parts FROM documents),
l AS (SELECT file_path, repo, lang, i AS line, parts[i] AS line_text, len(parts) AS n FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM d)),
lines AS (SELECT file_path, repo, lang, line, line_text FROM l WHERE line < n OR line_text <> '')"""
_RULE_VALUES = ", ".join(f"({i}, {sql_text(r.type)}, {sql_text(r.severity)}, {sql_text(r.regex)}, {sql_text(r.cwe)}, {sql_text(r.message)}, {sql_text(r.fix)}, {sql_text(r.explanation)})" for i, r in enumerate(_RULES))
_SQL_FINDINGS = f"""{_SQL_LINES},
r AS (SELECT * FROM (VALUES {_RULE_VALUES}) AS t(rule_ord, rule_id, severity, regex, cwe, message, fix, explanation)),
f AS (SELECT rule_id, severity, file_path, repo, line, line_text, rule_ord, cwe, message, fix, explanation, regex, regexp_extract(line_text, regex, 0, 'i') AS hit FROM lines JOIN r ON regexp_matches(line_text, regex, 'i')),
findings AS (SELECT rule_id, severity, file_path, repo, line::INTEGER AS line, instr(line_text, hit)::INTEGER AS "column", length(hit)::INTEGER AS length, cwe, message, fix, explanation, line_text, rule_ord, 'high' AS confidence FROM f)"""
_RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'info' THEN 4 ELSE 9 END"
_RANK4 = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 9 END"


def _with(select: str, pieces: str = _SQL_FINDINGS) -> str:
    return f"WITH {pieces}\n{select}"


# ---------------------------------------------------------------- scans and rules


@query("secret_scan", _with(f"""SELECT file_path, repo, line, "column", length, severity, cwe FROM findings WHERE rule_id = {sql_text(SECRET.type)}"""))
def secret_scan(spark, sf_dir):
    found = rules.line_findings(documents(spark, sf_dir), rules=(SECRET,))
    return findings.dedup(found).select("file_path", "repo", "line", "column", "length", "severity", "cwe")


@query("secret_scan_editor", _with(f"""SELECT file_path, line - 1 AS line, "column" - 1 AS "column", length FROM findings WHERE rule_id = {sql_text(SECRET.type)}"""))
def secret_scan_editor(spark, sf_dir):
    found = rules.editor_view(findings.dedup_editor(rules.line_findings(documents(spark, sf_dir), rules=(SECRET,), editor=True)))
    return found.select("file_path", "line", "column", "length")


@query("findings_full", _with("""SELECT rule_id, severity, file_path, line, "column", length, message, explanation, fix, cwe, confidence FROM findings"""))
def findings_full(spark, sf_dir):
    return prose_findings(spark, sf_dir).select("rule_id", "severity", "file_path", "line", "column", "length", "message", "explanation", "fix", "cwe", "confidence")


_CATALOG = ", ".join(f"({i}, {sql_text(r.type)}, {sql_text(r.severity)}, {sql_text(r.regex)}, {'[' + ', '.join(sql_text(x) for x in r.languages) + ']'}, {sql_text(r.cwe)})" for i, r in enumerate(rules.CATALOG))


_ADVICE = ", ".join("(" + ", ".join(sql_text(x) for x in (r.type, r.explanation, r.fix, r.example.split("Good: ")[1], r.cwe)) + ")" for r in rules.CATALOG)


@query("rules_on_snippets", f"""
WITH s AS (SELECT 'app/s' || i || '.' || language AS file_path, language, line FROM (VALUES {values(LINES)}) AS t(i, language, line)),
r AS (SELECT * FROM (VALUES {_CATALOG}) AS t(rule_ord, rule_id, severity, regex, languages, cwe)),
m AS (SELECT *, regexp_extract(line, regex, 0, 'i') AS hit FROM s JOIN r ON (list_contains(languages, '*') OR list_contains(languages, language)) AND regexp_matches(line, regex, 'i'))
SELECT file_path, rule_id, severity, cwe, 1 AS line, instr(line, hit)::INTEGER AS "column", length(hit)::INTEGER AS length FROM m
""")
def rules_on_snippets(spark, sf_dir):
    return findings.dedup(rules.line_findings(snippets(spark))).select("file_path", "rule_id", "severity", "cwe", "line", "column", "length")


@query("all_matches", _with("""SELECT file_path, line, i::INTEGER AS nth, length(hits[i + 1])::INTEGER AS length FROM (SELECT file_path, line, hits, unnest(range(len(hits))) AS i FROM (SELECT file_path, line::INTEGER AS line, regexp_extract_all(line_text, '[0-9]{4,}') AS hits FROM lines))""", _SQL_LINES))
def all_matches(spark, sf_dir):
    rows = explode_lines(documents(spark, sf_dir))
    return rows.select("file_path", "line", F.posexplode(rules.all_matches(F.col("line_text"), "[0-9]{4,}")).alias("nth", "m")).select("file_path", "line", "nth", "m.length")


@query("weak_crypto_lines", _with("SELECT file_path, line::INTEGER AS line FROM lines WHERE regexp_matches(line_text, '(^|[^\\p{L}\\p{N}_])(MD5|SHA1|DES|RC4|RC2)([^\\p{L}\\p{N}_]|$)', 'i')", _SQL_LINES))
def weak_crypto_lines(spark, sf_dir):
    rows = explode_lines(documents(spark, sf_dir))
    return rows.where(F.col("line_text").rlike(r"(?i)(^|[^\p{L}\p{N}_])(MD5|SHA1|DES|RC4|RC2)([^\p{L}\p{N}_]|$)")).select("file_path", "line")


@query("scan_pages", """
WITH l AS (SELECT page_id, url, unnest(string_split(html, chr(10))) AS t FROM pages)
SELECT url AS file_path, count(*)::BIGINT AS script_lines FROM l WHERE contains(t, '<script>') GROUP BY url
""")
def scan_pages(spark, sf_dir):
    rows = explode_lines(corpus.from_pages(table(spark, sf_dir, "pages")), keep_last_empty=True)
    return rows.where(F.col("line_text").contains("<script>")).groupBy("file_path").agg(F.count("*").alias("script_lines"))


@query("language_resolution", """
WITH p AS (SELECT p_partkey AS k, 'src/f' || p_partkey || (['.py', '.JS', '.tsx', '.rs', '.cxx', '.h', ''])[(p_partkey % 7 + 1)::INTEGER] AS path FROM part)
SELECT k, path, CASE k % 7 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'typescript' WHEN 3 THEN 'rust' WHEN 4 THEN 'cpp' WHEN 5 THEN 'h' ELSE '' END AS language FROM p
""")
def language_resolution(spark, sf_dir):
    ends = F.array(*[F.lit(x) for x in (".py", ".JS", ".tsx", ".rs", ".cxx", ".h", "")])
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("src/f"), F.col("p_partkey").cast("string"), F.element_at(ends, (F.col("p_partkey") % 7 + 1).cast("int"))).alias("path"))
    return rows.withColumn("language", language_of(F.col("path")))


@query("test_paths", """
WITH p AS (SELECT p_partkey AS k, (['lib/tests/a', 'lib/test_a', 'lib/a_test', 'src/latest_a', 'docs/a', 'my/docs/a'])[(p_partkey % 6 + 1)::INTEGER] || p_partkey || '.py' AS path FROM part)
SELECT k, path, k % 6 IN (0, 1, 5) AS is_test FROM p
""")
def test_paths(spark, sf_dir):
    heads = F.array(*[F.lit(x) for x in ("lib/tests/a", "lib/test_a", "lib/a_test", "src/latest_a", "docs/a", "my/docs/a")])
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.concat(F.element_at(heads, (F.col("p_partkey") % 6 + 1).cast("int")), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"))
    return rows.withColumn("is_test", is_test_path(F.col("path")))


# What the call and syntax-tree rules say of the samples, written down by hand: SQL has no parser to say it.
_RAISED = ", ".join(f"({i}, {sql_text(language)}, {sql_text(rule)}, {sql_text(severity)}, {sql_text(cwe)}, {line})" for i, (language, _, raised) in enumerate(CALLS) for rule, severity, cwe, line in raised)


@query("call_layer", f"""
SELECT 'app/c' || i || '.' || language AS file_path, rule_id || ' (call)' AS rule_id, severity, cwe, line, 'medium' AS confidence FROM (VALUES {_RAISED}) AS t(i, language, rule_id, severity, cwe, line)""")
def call_layer(spark, sf_dir):
    rows = spark.createDataFrame([(f"app/c{i}.{language}", language, text) for i, (language, text, _) in enumerate(CALLS)], "file_path string, language string, content string")
    return findings.dedup(calls.call_findings(rows)).select("file_path", "rule_id", "severity", "cwe", "line", "confidence")


@query("python_tree_layer", """
SELECT file_path, rule_id || ' (AST)' AS rule_id, severity, line, col AS "column", length, cwe, confidence FROM (VALUES
  ('app/a.py', 'SQL Injection', 'critical', 3, 0, 10, 'CWE-89', 'high'), ('app/a.py', 'Command Injection', 'critical', 4, 0, 10, 'CWE-78', 'high'), ('app/a.py', 'Hardcoded Secret', 'critical', 2, 0, 8, 'CWE-798', 'high'),
  ('app/a.py', 'Insecure Deserialization', 'critical', 5, 4, 10, 'CWE-502', 'high'), ('app/a.py', 'Path Traversal', 'high', 6, 4, 10, 'CWE-22', 'high'), ('app/a.py', 'Path Traversal', 'high', 6, 4, 10, 'CWE-22', 'high'),
  ('app/d.py', 'Cross-Site Scripting', 'high', 1, 0, 10, 'CWE-79', 'medium'), ('app/d.py', 'Path Traversal', 'high', 2, 0, 10, 'CWE-22', 'high')) AS t(file_path, rule_id, severity, line, col, length, cwe, confidence)""")
def python_tree_layer(spark, sf_dir):
    return python_ast.python_findings(spark.createDataFrame(list(PYTHON), "file_path string, content string")).select("file_path", "rule_id", "severity", "line", "column", "length", "cwe", "confidence")


@query("heuristic_layer", f"""
WITH s AS (SELECT 'app/s' || i || '.' || CASE language WHEN 'javascript' THEN 'js' WHEN 'rust' THEN 'rs' WHEN 'typescript' THEN 'ts' ELSE language END AS file_path, line FROM (VALUES {values(LINES)}) AS t(i, language, line))
SELECT file_path, 'Rust: Unsafe Block (line)' AS rule_id, length(line)::INTEGER AS length FROM s WHERE file_path LIKE '%.rs' AND contains(line, 'unsafe') AND contains(line, '{{')
UNION ALL SELECT file_path, 'Go: SQL Injection (line)', length(line)::INTEGER FROM s WHERE file_path LIKE '%.go' AND regexp_matches(line, '(db\\.Query|db\\.Exec|db\\.QueryRow)\\s*\\(\\s*fmt\\.Sprintf', 'i')
UNION ALL SELECT file_path, 'eval() with user input (line)', length(line)::INTEGER FROM s WHERE regexp_matches(file_path, '(js|ts)$') AND regexp_matches(line, 'eval\\s*\\(\\s*[^)]*\\b(req|input|param|query|body|user)', 'i')
UNION ALL SELECT file_path, 'XSS: innerHTML (line)', length(line)::INTEGER FROM s WHERE regexp_matches(file_path, '(js|ts)$') AND contains(line, 'innerHTML') AND contains(line, 'const ') AND contains(line, '=')
""")
def heuristic_layer(spark, sf_dir):
    ends = {"javascript": "js", "rust": "rs", "typescript": "ts"}
    rows = spark.createDataFrame([(f"app/s{i}.{ends.get(language, language)}", language, line) for i, (language, line) in enumerate(LINES)], "file_path string, language string, content string")
    return heuristics.heuristic_findings(rows).select("file_path", "rule_id", "length")


@query("entropy_secrets", _with("""
SELECT file_path, line::INTEGER AS line, length(v)::INTEGER AS length, round(e, 6) AS bits FROM (
  SELECT file_path, line, v, list_sum(list_transform(list_distinct(string_split(v, '')), lambda c: -((length(v) - length(replace(v, c, '')))::DOUBLE / length(v)) * log2((length(v) - length(replace(v, c, '')))::DOUBLE / length(v)))) AS e
  FROM (SELECT file_path, line, regexp_extract(line_text, '["'']([A-Za-z0-9+/=_-]{20,})["'']', 1) AS v FROM lines) WHERE v <> '') WHERE e >= 3.5""", _SQL_LINES))
def entropy_secrets(spark, sf_dir):
    rows = explode_lines(documents(spark, sf_dir)).withColumn("v", F.regexp_extract("line_text", heuristics.QUOTED, 1)).where("v <> ''")
    rows = rows.withColumn("bits", entropy(F.col("v"))).where(F.col("bits") >= heuristics.LEAST_BITS)
    return rows.select("file_path", "line", F.length("v").alias("length"), F.round("bits", 6).alias("bits"))


@query("secret_layer", _with("""
SELECT file_path, 'Secret: High Entropy Value' AS rule_id, line::INTEGER AS line, (instr(line_text, q) + 1)::INTEGER AS "column", length(v)::INTEGER AS length FROM (
  SELECT file_path, line, line_text, q, v, list_sum(list_transform(list_distinct(string_split(v, '')), lambda c: -((length(v) - length(replace(v, c, '')))::DOUBLE / length(v)) * log2((length(v) - length(replace(v, c, '')))::DOUBLE / length(v)))) AS e
  FROM (SELECT file_path, line, line_text, regexp_extract(line_text, '["'']([A-Za-z0-9+/=_-]{20,})["'']', 0) AS q, regexp_extract(line_text, '["'']([A-Za-z0-9+/=_-]{20,})["'']', 1) AS v FROM lines) WHERE v <> '') WHERE e >= 3.5""", _SQL_LINES))
def secret_layer(spark, sf_dir):
    return findings.dedup(heuristics.secret_findings(documents(spark, sf_dir))).select("file_path", "rule_id", "line", "column", "length")


_WEAK = r"(^|[^\p{L}\p{N}_])(MD5|SHA1|DES|RC4|RC2)([^\p{L}\p{N}_]|$)"
_FAMILIES = ", ".join(f"({sql_text('Secret: ' + name)}, {sql_text(p)})" for name, p in heuristics.SECRET_FAMILIES)
_BITS = "list_sum(list_transform(list_distinct(string_split(v, '')), lambda c: -((length(v) - length(replace(v, c, '')))::DOUBLE / length(v)) * log2((length(v) - length(replace(v, c, '')))::DOUBLE / length(v))))"


@query("full_scan", f"""
WITH d AS (SELECT coalesce(source, 'none') || '/' || doc_id || '.txt' AS file_path, text AS content FROM documents UNION ALL SELECT url, html FROM pages),
p AS (SELECT file_path, string_split(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS parts FROM d
  WHERE NOT regexp_matches(lower(file_path), '(/(tests|test|__pycache__|fixtures|examples|docs|vendor|node_modules)/|(^|/)(test_|conftest[.])[^/]*$|(_test[.]|[.]test[.]|spec_)[^/]*$)')),
l AS (SELECT file_path, i::INTEGER AS line, parts[i] AS t FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM p)),
hit AS (
  SELECT {sql_text(SECRET.type)} AS rule_id, 'regex' AS analyzer, {sql_text(SECRET.severity)} AS severity, file_path, line FROM l WHERE regexp_matches(t, {sql_text(SECRET.regex)}, 'i')
  UNION ALL SELECT {sql_text(rules.CATALOG[7].type)}, 'regex', {sql_text(rules.CATALOG[7].severity)}, file_path, line FROM l WHERE regexp_matches(t, {sql_text(_WEAK)}, 'i')
  UNION ALL SELECT rule_id, 'secret', 'critical', file_path, line FROM l JOIN (VALUES {_FAMILIES}) AS f(rule_id, p) ON regexp_matches(t, p)
  UNION ALL SELECT 'Secret: High Entropy Value', 'secret', 'critical', file_path, line FROM (SELECT file_path, line, {_BITS} AS e FROM (SELECT file_path, line, regexp_extract(t, '["'']([A-Za-z0-9+/=_-]{{20,}})["'']', 1) AS v FROM l) WHERE v <> '') WHERE e >= 3.5)
SELECT DISTINCT rule_id, severity, file_path, line, analyzer FROM hit
""")
def full_scan(spark, sf_dir):
    pages = corpus.from_pages(table(spark, sf_dir, "pages"))
    return plans.scan(documents(spark, sf_dir).unionByName(pages)).select("rule_id", "severity", "file_path", "line", "analyzer")


@query("snippet_scan")
def snippet_scan(spark, sf_dir):
    """The whole plan over code samples, tested against its layers one by one."""
    return plans.scan(sample_files(spark)).select("rule_id", "severity", "file_path", "line", "analyzer")


@query("custom_rules", _with("""SELECT rule_id, count(*)::BIGINT AS n FROM findings WHERE rule_ord > 0 GROUP BY rule_id"""))
def custom_rules(spark, sf_dir):
    import json

    text = json.dumps({"customPatterns": [{"type": r.type, "severity": r.severity, "regex": r.regex, "languages": list(r.languages), "cwe": r.cwe} for r in PROSE] + [{"type": "bad", "regex": "("}]})
    found = rules.line_findings(documents(spark, sf_dir), rules=(), custom=corpus.parse_rules(text, "customPatterns"))
    return findings.dedup(found).groupBy("rule_id").agg(F.count("*").alias("n"))


@query("staged_files", """SELECT coalesce(source, 'none') || '/' || doc_id || '.txt' AS file_path FROM documents WHERE lang = 'de'""")
def staged_files(spark, sf_dir):
    changed = corpus.from_documents(table(spark, sf_dir, "documents").where("lang = 'de'")).select("file_path")
    return findings.staged(documents(spark, sf_dir), changed, (".txt",)).select("file_path")


# ---------------------------------------------------------------- findings algebra


@query("severity_counts", _with("SELECT severity, count(*)::BIGINT AS n FROM findings GROUP BY severity"))
def severity_counts(spark, sf_dir):
    return findings.severity_counts(prose_findings(spark, sf_dir))


@query("repo_counts", _with("SELECT repo, count(*)::BIGINT AS n, count(DISTINCT file_path)::BIGINT AS files FROM findings GROUP BY repo"))
def repo_counts(spark, sf_dir):
    repo = F.substring_index("file_path", "/", 1).alias("repo")
    return prose_findings(spark, sf_dir).groupBy(repo).agg(F.count("*").alias("n"), F.count_distinct("file_path").alias("files"))


@query("grouped_findings", _with("SELECT severity, count(*) OVER (PARTITION BY severity)::BIGINT AS n, row_number() OVER (PARTITION BY severity ORDER BY file_path, line, \"column\", rule_id)::BIGINT AS nth, file_path, line, rule_id FROM findings"))
def grouped_findings(spark, sf_dir):
    return findings.grouped(prose_findings(spark, sf_dir)).select("severity", "n", "nth", "file_path", "line", "rule_id")


@query("catalog_stats", f"""
WITH r AS (SELECT * FROM (VALUES {_CATALOG}) AS t(rule_ord, rule_id, severity, regex, languages, cwe)), x AS (SELECT DISTINCT unnest(languages) AS g FROM r)
SELECT (SELECT count(*) FROM r)::BIGINT AS rules, (SELECT string_agg(g, ',' ORDER BY g) FROM x WHERE g <> '*') AS languages
""")
def catalog_stats(spark, sf_dir):
    return findings.catalog_stats(rules.rules_frame(spark)).select("rules", F.array_join("languages", ",").alias("languages"))


@query("ranked_top", _with(f"""SELECT rule_id, severity, file_path, line FROM findings ORDER BY {_RANK}, file_path, line, CASE WHEN rule_ord = 0 THEN 0 ELSE rule_ord END, "column" LIMIT 20"""))
def ranked_top(spark, sf_dir):
    return findings.rank(prose_findings(spark, sf_dir)).select("rule_id", "severity", "file_path", "line").limit(20)


@query("top_findings", _with(f"""SELECT rule_id, file_path, line FROM findings WHERE severity IN ('critical', 'high') ORDER BY {_RANK}, file_path, line, rule_ord, "column" LIMIT 5"""))
def top_findings(spark, sf_dir):
    return findings.top_findings(prose_findings(spark, sf_dir)).select("rule_id", "file_path", "line")


@query("env_gate", _with("SELECT e AS environment, count(*)::BIGINT AS n FROM findings JOIN (VALUES ('dev', ['critical', 'high', 'medium', 'low']), ('staging', ['critical', 'high']), ('prod', ['critical'])) AS t(e, s) ON list_contains(s, severity) GROUP BY e"))
def env_gate(spark, sf_dir):
    looked_at = [F.when(F.col("severity").isin(*findings.gate(name)), F.lit(name)) for name in findings.ENVIRONMENTS]
    rows = prose_findings(spark, sf_dir).select(F.explode(F.array_compact(F.array(*looked_at))).alias("environment"))
    return rows.groupBy("environment").agg(F.count("*").alias("n"))


@query("fail_on", _with(f"SELECT file_path, max(({_RANK4} <= 1)::INTEGER) AS fails_high FROM findings GROUP BY file_path"))
def fail_on(spark, sf_dir):
    return prose_findings(spark, sf_dir).groupBy("file_path").agg(F.max(findings.fails_at(F.col("severity"), "high").cast("int")).alias("fails_high"))


@query("severity_override", _with("SELECT CASE rule_id WHEN 'Email Address' THEN 'critical' WHEN 'License Line' THEN 'low' ELSE severity END AS severity, count(*)::BIGINT AS n FROM findings GROUP BY 1"))
def severity_override(spark, sf_dir):
    return findings.severity_counts(findings.override_severity(prose_findings(spark, sf_dir), {"Email Address": "critical", "License Line": "low"}))


@query("path_exclusion", _with("SELECT file_path, count(*)::BIGINT AS n FROM findings WHERE NOT contains(file_path, 'src1/') AND NOT contains(file_path, '7.txt') GROUP BY file_path"))
def path_exclusion(spark, sf_dir):
    return findings.exclude_paths(prose_findings(spark, sf_dir), ["src1/", "7.txt"]).groupBy("file_path").agg(F.count("*").alias("n"))


@query("suppression", _with("SELECT rule_id, count(*)::BIGINT AS n FROM findings WHERE NOT (rule_id = 'Email Address' AND (contains(file_path, 'src2/') OR contains(file_path, 'src3/'))) GROUP BY rule_id"))
def suppression(spark, sf_dir):
    return findings.suppress(prose_findings(spark, sf_dir), {"Email Address": ["src2/", "src3/"]}).groupBy("rule_id").agg(F.count("*").alias("n"))


@query("deep_gate", _with("""SELECT d.file_path FROM (SELECT coalesce(source, 'none') || '/' || doc_id || '.txt' AS file_path, text FROM documents) d LEFT JOIN (SELECT file_path, count(*) AS n, max((severity = 'critical')::INT) AS c FROM findings GROUP BY 1) f USING (file_path)
WHERE (regexp_matches(text, '(eval\\s*\\(|exec\\s*\\(|innerHTML|password|secret|token)', 'i') OR c = 1 OR n > 3) AND len(string_split(text, chr(10))) <= 1000"""))
def deep_gate(spark, sf_dir):
    return findings.deep_gate(documents(spark, sf_dir), prose_findings(spark, sf_dir))


@query("drift", _with("""SELECT 'new' AS kind, count(*)::BIGINT AS n FROM findings WHERE k % 3 = 0 UNION ALL SELECT 'resolved', count(*) FROM findings WHERE k % 3 = 1 UNION ALL SELECT 'persisting', count(*) FROM findings WHERE k % 3 = 2""".replace("FROM findings", "FROM (SELECT *, regexp_extract(file_path, '([0-9]+)[.]txt', 1)::BIGINT AS k FROM findings)")))
def drift(spark, sf_dir):
    found = prose_findings(spark, sf_dir).withColumn("k", F.regexp_extract("file_path", r"([0-9]+)[.]txt", 1).cast("long"))
    before, now = found.where("k % 3 <> 0"), found.where("k % 3 <> 1")
    one = lambda name, df: df.agg(F.lit(name).alias("kind"), F.count("*").alias("n"))
    return one("new", findings.drift_new(now, before)).union(one("resolved", findings.drift_resolved(now, before))).union(one("persisting", findings.drift_persisting(now, before)))


@query("regressions", _with("SELECT rule_id, file_path, line FROM findings WHERE regexp_extract(file_path, '([0-9]+)[.]txt', 1)::BIGINT % 5 = 1"))
def regressions(spark, sf_dir):
    found = prose_findings(spark, sf_dir).withColumn("k", F.regexp_extract("file_path", r"([0-9]+)[.]txt", 1).cast("long"))
    return findings.regressions(found, found.where("k % 5 <> 1"), found).select("rule_id", "file_path", "line")


@query("cross_repo_systemic", _with("SELECT sha256(trim(lower(line_text))) AS fingerprint, count(DISTINCT repo)::BIGINT AS repos, count(DISTINCT file_path)::BIGINT AS files FROM lines WHERE line_text <> '' GROUP BY 1 HAVING count(DISTINCT repo) >= 2", _SQL_LINES))
def cross_repo_systemic(spark, sf_dir):
    return findings.systemic(explode_lines(documents(spark, sf_dir)).where("line_text <> ''"))


@query("fingerprints", _with("SELECT rule_id, sha256(file_path || chr(1) || line || chr(1) || rule_id) AS fingerprint FROM findings"))
def fingerprints(spark, sf_dir):
    return findings.fingerprint(prose_findings(spark, sf_dir)).select("rule_id", "fingerprint")


@query("composite_priority", _with(f"SELECT file_path, line, rule_id, greatest({_RANK} - least((cwe IS NOT NULL)::INT + contains(file_path, '1')::INT + (line > 2)::INT, 2), 0)::INTEGER AS priority FROM findings"))
def composite_priority(spark, sf_dir):
    found = prose_findings(spark, sf_dir).withColumns({"s1": F.col("cwe").isNotNull(), "s2": F.col("file_path").contains("1"), "s3": F.col("line") > 2})
    return findings.composite_priority(found, ["s1", "s2", "s3"]).select("file_path", "line", "rule_id", "priority")


@query("root_causes", _with("SELECT cwe, regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS directory, count(*)::BIGINT AS n FROM findings GROUP BY 1, 2"))
def root_causes(spark, sf_dir):
    return findings.root_causes(prose_findings(spark, sf_dir))


@query("report_totals", _with("SELECT count(*)::BIGINT AS tests, (count(*) FILTER (severity IN ('critical', 'high')))::BIGINT AS failures FROM findings"))
def report_totals(spark, sf_dir):
    return findings.totals(prose_findings(spark, sf_dir))


@query("tenant_isolation", "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey = 7")
def tenant_isolation(spark, sf_dir):
    return findings.tenant_view(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), 7, "c_nationkey")


@query("scan_anomalies", """WITH h AS (SELECT user_id, (hour(ts) % 6)::INTEGER AS scan, count(*)::BIGINT AS n FROM events GROUP BY 1, 2),
b AS (SELECT user_id, avg(n) AS mean, stddev_pop(n) AS dev FROM h WHERE scan < 5 GROUP BY 1)
SELECT h.user_id, n, round(mean, 6) AS mean, CASE WHEN dev > 0 THEN round(abs(n - mean) / dev, 6) END AS score, coalesce(CASE WHEN dev > 0 THEN abs(n - mean) / dev >= 2 ELSE abs(n - mean) > 0 END, false) AS anomalous FROM h LEFT JOIN b USING (user_id) WHERE scan = 5""")
def scan_anomalies(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("user_id", (F.hour("ts") % 6).alias("scan")).agg(F.count("*").alias("n"))
    rows = findings.anomalies(counts.where("scan < 5"), counts.where("scan = 5"), "user_id", 2.0)
    return rows.select("user_id", "n", F.round("mean", 6).alias("mean"), F.round("score", 6).alias("score"), "anomalous")


_SURFACE = ", ".join(f"CASE WHEN contains(lower(url), '{w}') THEN {v}::DOUBLE ELSE 1.0::DOUBLE END" for w, v in findings.SURFACE)


@query("surface_weights", f"SELECT page_id, greatest({_SURFACE}) AS weight FROM pages")
def surface_weights(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", findings.surface_weight(F.col("url")).alias("weight"))


@query("tool_counts", "WITH w AS (SELECT DISTINCT conv_id, turn, unnest(string_split(text, ' ')) AS tool FROM conversations WHERE text IS NOT NULL) SELECT tool, count(*)::BIGINT AS events FROM w GROUP BY tool")
def tool_counts(spark, sf_dir):
    return findings.learning_counts(table(spark, sf_dir, "conversations").dropDuplicates(["conv_id", "turn", "text"]).select(F.split("text", " ").alias("tools")))


# ---------------------------------------------------------------- knowledge and scores

_MITRE = ", ".join(f"('{k}', '{','.join(a)}', '{','.join(b)}')" for k, (a, b) in knowledge.MITRE.items())
_CWE = ", ".join(f"('{k}', {sql_text(v[0])})" for k, v in knowledge.CWE.items())
_FEEDBACK = f"""{_SQL_FINDINGS},
fb AS (SELECT findings.*, coalesce(te, 'T1595') AS techniques, coalesce(ta, 'TA0043') AS tactics, coalesce(cwe, '') AS w,
  floor(CASE severity WHEN 'critical' THEN 90 WHEN 'high' THEN 70 WHEN 'medium' THEN 50 WHEN 'low' THEN 30 ELSE 50 END * 0.8::DOUBLE + 0.5)::INTEGER AS priority_score FROM findings LEFT JOIN (VALUES {_MITRE}) AS m(c, te, ta) ON c = cwe)"""


@query("cwe_enrich", _with(f"SELECT findings.cwe, name, count(*)::BIGINT AS n FROM findings LEFT JOIN (VALUES {_CWE}) AS k(c, name) ON c = findings.cwe GROUP BY 1, 2"))
def cwe_enrich(spark, sf_dir):
    return knowledge.with_cwe(prose_findings(spark, sf_dir)).groupBy("cwe", "name").agg(F.count("*").alias("n"))


_OWASP = ", ".join(f"('{k}', '{v}')" for k, v in knowledge.OWASP.items())


@query("owasp_kev", _with(f"SELECT file_path, line, rule_id, owasp, coalesce(cwe IN ('CWE-798', 'CWE-200'), false) AS kev FROM findings LEFT JOIN (VALUES {_OWASP}) AS o(c, owasp) ON c = cwe"))
def owasp_kev(spark, sf_dir):
    exploited = spark.createDataFrame([("CWE-798",), ("CWE-200",), ("CWE-200",), (None,)], "cwe string")
    return knowledge.with_kev(knowledge.with_owasp(prose_findings(spark, sf_dir)), exploited).select("file_path", "line", "rule_id", "owasp", "kev")


@query("severity_texts", _with("SELECT severity, CASE severity " + " ".join(f"WHEN '{k}' THEN {sql_text(v)}" for k, v in knowledge.SEVERITY_TEXT.items()) + " END AS severity_text, count(*)::BIGINT AS n FROM findings GROUP BY 1, 2"))
def severity_texts(spark, sf_dir):
    return knowledge.with_severity_text(prose_findings(spark, sf_dir)).groupBy("severity", "severity_text").agg(F.count("*").alias("n"))


@query("file_context", "SELECT page_id, " + " || ".join(f"CASE WHEN contains(lower(url), '{w}') THEN {sql_text(t)} || ';' ELSE '' END" for w, t in knowledge.FILE_CONTEXT) + " AS advice FROM pages")
def file_context(spark, sf_dir):
    advice = F.array_join(F.transform(knowledge.file_contexts(F.col("url")), lambda x: F.concat(x, F.lit(";"))), "")
    return table(spark, sf_dir, "pages").select("page_id", advice.alias("advice"))


@query("mitre_feedback", f"WITH {_FEEDBACK} SELECT file_path, line, rule_id, techniques, tactics, priority_score, CASE WHEN w LIKE 'CWE-89%' OR w LIKE 'CWE-79%' OR w LIKE 'CWE-918%' THEN 'network' WHEN w LIKE 'CWE-78%' THEN 'adjacent' ELSE 'local' END AS attack_vector, CASE WHEN w LIKE 'CWE-798%' OR w LIKE 'CWE-327%' THEN 'low' WHEN w LIKE 'CWE-89%' OR w LIKE 'CWE-78%' THEN 'medium' ELSE 'high' END AS complexity FROM fb")
def mitre_feedback(spark, sf_dir):
    rows = knowledge.feedback(prose_findings(spark, sf_dir))
    return rows.select("file_path", "line", "rule_id", F.array_join("techniques", ",").alias("techniques"), F.array_join("tactics", ",").alias("tactics"), "priority_score", "attack_vector", "complexity")


@query("feedback_bands", f"WITH {_FEEDBACK} SELECT count(*)::BIGINT AS total, (count(*) FILTER (priority_score >= 80))::BIGINT AS critical, (count(*) FILTER (priority_score >= 60 AND priority_score < 80))::BIGINT AS high FROM fb")
def feedback_bands(spark, sf_dir):
    return knowledge.feedback_summary(knowledge.feedback(prose_findings(spark, sf_dir)))


@query("topn_tactics", f"WITH {_FEEDBACK} SELECT tactic, count(*)::BIGINT AS n FROM (SELECT unnest(string_split(tactics, ',')) AS tactic FROM fb) GROUP BY tactic ORDER BY n DESC, tactic LIMIT 5")
def topn_tactics(spark, sf_dir):
    rows = knowledge.feedback(prose_findings(spark, sf_dir)).select(F.explode("tactics").alias("tactic"))
    return findings.top_words(rows, "tactic", 5)


_SEV_SQL = "CASE severity " + " ".join(f"WHEN '{k}' THEN {sql_text(v)}" for k, v in knowledge.SEVERITY_TEXT.items()) + " END"
_CTX_SQL = ", ".join(f"CASE WHEN contains(lower(file_path), '{w}') THEN chr(10) || {sql_text('CONTEXT: ' + t)} END" for w, t in knowledge.FILE_CONTEXT)
_KNOW = ", ".join("(" + ", ".join(sql_text(x) for x in (k, *v)) + ")" for k, v in knowledge.CWE.items())


@query("explanation_text", _with(f"""SELECT file_path, line, rule_id, concat_ws(chr(10), 'Found with severity ' || upper(severity) || ': **' || rule_id || '**', 'Detection method: pattern matching', 'Location: ' || file_path || ':' || line,
  chr(10) || 'WHAT IS ' || upper(name) || '?' || chr(10) || attack, chr(10) || 'HOW BAD IS THIS?' || chr(10) || impact, chr(10) || 'HOW TO FIX:' || chr(10) || prevention, chr(10) || 'PRIORITY: ' || {_SEV_SQL}, {_CTX_SQL},
  CASE WHEN fix <> '' THEN chr(10) || 'SPECIFIC FIX: ' || fix END) AS explanation FROM findings LEFT JOIN (VALUES {_KNOW}) AS k(c, name, attack, impact, prevention) ON c = cwe"""))
def explanation_text(spark, sf_dir):
    return knowledge.explanation(knowledge.with_cwe(prose_findings(spark, sf_dir))).select("file_path", "line", "rule_id", "explanation")


_CLS = "lower(rule_id || ' ' || message || ' ' || coalesce(cwe, ''))"
_CLASS = {part: "CASE " + " ".join("WHEN " + " OR ".join(f"contains(t, '{w}')" for w in words) + f" THEN {value}" for (_, words, base, most), value in ((c, (sql_text(c[0]), f'{c[2]}::DOUBLE', f'{c[3]}::DOUBLE')[part]) for c in exploitability.CLASSES)) + f" ELSE {(sql_text('general'), '3.0::DOUBLE', '7.0::DOUBLE')[part]} END" for part in range(3)}
_add = lambda words, d: f"CASE WHEN regexp_matches(x, '{words}') THEN {d}::DOUBLE ELSE 0::DOUBLE END"
_SCORED = f"""{_SQL_FINDINGS},
sc0 AS (SELECT *, {_CLS} AS t, lower(line_text) AS x FROM findings),
sc1 AS (SELECT *, {_CLASS[0]} AS exploit_class, {_CLASS[1]} AS base, {_CLASS[2]} AS most,
  CASE WHEN regexp_matches(x, 'http|fetch|axios|request|socket|ws://|wss://') THEN 'Network' WHEN regexp_matches(x, 'file|path|open|read|write') THEN 'Local' WHEN regexp_matches(x, 'physical|usb|nfc|bluetooth') THEN 'Physical' ELSE 'Network' END AS attack_vector,
  CASE WHEN regexp_matches(x, 'admin|root|sudo|superuser|privileged') THEN 'Admin' WHEN regexp_matches(x, 'user|authenticated|login|session') THEN 'Authenticated' ELSE 'None' END AS auth_required,
  least(0.3::DOUBLE + {_add('auth|login|token|session|cookie', 0.2)} + {_add('csrf|nonce|captcha|challenge', 0.2)} + {_add('rate.limit|timeout|retry|backoff', 0.1)} + {_add('validate|sanitize|escape|filter', 0.3)}, 1.0::DOUBLE) AS cx,
  least(0.5::DOUBLE + {_add('public|api|route|endpoint|exposed|open|/[0-9A-Za-z_]+/[0-9A-Za-z_]+', 0.3)} + {_add('debug|test|dev|staging|local', 0.2)} + {_add('param|query|body|input|user', 0.2)}, 1.0::DOUBLE) AS dc,
  regexp_matches(lower(rule_id || ' ' || coalesce(cwe, '')), '{exploitability.PUBLIC}') AS public_exploit FROM sc0),
sc2 AS (SELECT *, base * CASE severity WHEN 'critical' THEN 1.5::DOUBLE WHEN 'high' THEN 1.2::DOUBLE WHEN 'low' THEN 0.7::DOUBLE WHEN 'info' THEN 0.4::DOUBLE ELSE 1.0::DOUBLE END * 1.2::DOUBLE
  * CASE attack_vector WHEN 'Network' THEN 1.3::DOUBLE WHEN 'Local' THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END * CASE auth_required WHEN 'None' THEN 1.0::DOUBLE WHEN 'Authenticated' THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END
  * (1.0::DOUBLE - cx * 0.4::DOUBLE) * (1.0::DOUBLE + dc * 0.3::DOUBLE) * CASE WHEN public_exploit THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS raw FROM sc1),
scored AS (SELECT *, round_even(greatest(0, least(raw, most)), 1) AS exploitability_score FROM sc2)"""


@query("exploitability", f"WITH {_SCORED} SELECT file_path, line, rule_id, exploit_class, attack_vector, auth_required, public_exploit, round(exploitability_score * 10)::BIGINT AS tenths, CASE WHEN exploitability_score >= 7 THEN 'Critical' WHEN exploitability_score >= 4 THEN 'High' WHEN exploitability_score >= 2 THEN 'Medium' ELSE 'Low' END AS exploitability_label FROM scored")
def exploitability_query(spark, sf_dir):
    rows = exploitability.score(prose_findings(spark, sf_dir))
    return rows.select("file_path", "line", "rule_id", "exploit_class", "attack_vector", "auth_required", "public_exploit", F.round(F.col("exploitability_score") * 10).cast("long").alias("tenths"), "exploitability_label")


@query("exploitability_summary", f"WITH {_SCORED} SELECT round(avg(exploitability_score), 4) AS average, max(exploitability_score) AS max, (count(*) FILTER (exploitability_score >= 7))::BIGINT AS critical_count, count(*)::BIGINT AS total FROM scored")
def exploitability_summary(spark, sf_dir):
    rows = exploitability.score(prose_findings(spark, sf_dir)).persist()
    s = exploitability.summary(rows)
    return s.drop("average").crossJoin(rows.agg(F.round(F.avg("exploitability_score"), 4).alias("average")))


@query("remediation_plan", _with(f"SELECT row_number() OVER (ORDER BY {_RANK4}, file_path, line, rule_id) AS n, rule_id, file_path FROM findings"))
def remediation_plan(spark, sf_dir):
    rows = reports.remediation_plan(prose_findings(spark, sf_dir))
    text = F.col("text")
    return rows.select("n", F.regexp_extract(text, r"(?m)^[0-9]+\. (.*)$", 1).alias("rule_id"), F.regexp_extract(text, r"(?m)^   File: (.*):[0-9]+$", 1).alias("file_path"))


# ---------------------------------------------------------------- sessions, events, candidates

_SESSIONS = """s AS (SELECT conv_id, max(turn)::INTEGER AS duration, list(text ORDER BY turn) FILTER (role = 'user' AND text IS NOT NULL) AS c0 FROM conversations GROUP BY conv_id),
sessions AS (SELECT conv_id, duration, coalesce(c0, []) AS commands FROM s)"""


@query("session_triage", f"WITH {_SESSIONS} SELECT conv_id, len(commands)::INTEGER AS n_commands, CASE WHEN len(commands) >= 3 THEN 'threat' ELSE 'scanner' END AS verdict FROM sessions")
def session_triage(spark, sf_dir):
    return sessions.triage(corpus.sessions_of(table(spark, sf_dir, "conversations"))).select("conv_id", F.size("commands").alias("n_commands"), "verdict")


@query("attacker_class", f"""WITH {_SESSIONS}, k AS (SELECT conv_id, lower(array_to_string(commands, ' ')) AS t, duration, len(commands) AS n FROM sessions),
c AS (SELECT conv_id, CASE WHEN duration = 0 AND n = 0 THEN 'scanner' WHEN duration > 30 AND n > 0 AND regexp_matches(t, 'wget|curl|chmod [+]x|[.]/|chmod 777') THEN 'ransomware_dropper' WHEN duration > 30 AND n > 0 THEN 'interactive_attacker' WHEN n > 0 THEN 'script_based_attacker' ELSE 'scanner' END AS attacker_class FROM k)
SELECT conv_id, attacker_class, CASE attacker_class WHEN 'scanner' THEN 'T1046' WHEN 'interactive_attacker' THEN 'T1059' WHEN 'ransomware_dropper' THEN 'T1204.002' ELSE 'T1059.006' END AS ttp FROM c""")
def attacker_class(spark, sf_dir):
    return sessions.attacker_class(corpus.sessions_of(table(spark, sf_dir, "conversations"))).select("conv_id", "attacker_class", "ttp")


_EVENTS = """e AS (SELECT event_id, ['run ' || (['sqlmap -u x', 'cat .env', 'cmd /c dir', 'ls ../..', 'uname'])[(event_id % 5 + 1)::INTEGER]] AS commands, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'CWE-1' END AS cwe, CASE WHEN event_id % 4 = 0 THEN ['TA0001'] END AS tactics FROM events),
g AS (SELECT *, array_to_string(commands, ' ') AS t FROM e WHERE cwe IS NOT NULL OR tactics IS NOT NULL),
cand AS (SELECT event_id, CASE WHEN contains(t, 'sql') THEN 'Learned: SQL Injection (attacker-observed)' WHEN contains(t, 'cat .env') THEN 'Learned: Credential Exposure (attacker-observed)' WHEN contains(t, 'cmd') THEN 'Learned: Command Injection (attacker-observed)' WHEN contains(t, '../') THEN 'Learned: Path Traversal (attacker-observed)' END AS proposed_type, t FROM g)"""


def intel_events(spark, sf_dir) -> DataFrame:
    """The event table as attacker events."""
    words = F.array(*[F.lit(x) for x in ("sqlmap -u x", "cat .env", "cmd /c dir", "ls ../..", "uname")])
    rows = table(spark, sf_dir, "events")
    return rows.select(
        "event_id", "ts", F.array(F.concat(F.lit("run "), F.element_at(words, (F.col("event_id") % 5 + 1).cast("int")))).alias("commands"),
        F.when(F.col("event_id") % 3 != 0, "CWE-1").alias("cwe"), F.when(F.col("event_id") % 4 == 0, F.array(F.lit("TA0001"))).alias("matched_tactics"),
    )


@query("candidate_rules", f"WITH {_EVENTS} SELECT event_id, proposed_type, t AS behavior FROM cand WHERE proposed_type IS NOT NULL")
def candidate_rules(spark, sf_dir):
    return sessions.candidates(intel_events(spark, sf_dir)).select("event_id", "proposed_type", "behavior")


@query("candidate_summary", f"WITH {_EVENTS} SELECT severity, count(*)::BIGINT AS n FROM (SELECT CASE WHEN contains(proposed_type, 'Path') THEN 'high' ELSE 'critical' END AS severity FROM cand WHERE proposed_type IS NOT NULL AND NOT contains(proposed_type, 'Credential')) GROUP BY ROLLUP(severity)")
def candidate_summary(spark, sf_dir):
    found = sessions.candidates(intel_events(spark, sf_dir))
    approved = spark.createDataFrame([("Learned: Credential Exposure (attacker-observed)",)], "proposed_type string")
    return sessions.candidate_summary(sessions.by_confidence(sessions.drop_approved(found, approved), 0.6))


@query("event_stream_latest", "SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id))::BIGINT AS event_id FROM events GROUP BY user_id")
def event_stream_latest(spark, sf_dir):
    return streams.latest(table(spark, sf_dir, "events").select("user_id", "ts", "event_id"), "user_id", "ts", "event_id").select("user_id", "ts", "event_id")


@query("event_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    return streams.tumbling(table(spark, sf_dir, "events"))


@query("event_sessions", """WITH o AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS b FROM events),
g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, min(ts) AS first, max(ts) AS last, count(*)::BIGINT AS events, (count(*) FILTER (event_type = 'error'))::BIGINT AS failed, (count(*) FILTER (event_type IN ('purchase', 'click')))::BIGINT AS commands FROM g GROUP BY user_id, k""")
def event_sessions(spark, sf_dir):
    return streams.attacker_sessions(table(spark, sf_dir, "events"))


@query("honeypot_union", "SELECT honeypot_type, count(*)::BIGINT AS n, count(payload_hash)::BIGINT AS hashed FROM (SELECT 'ssh' AS honeypot_type, NULL AS payload_hash FROM events WHERE event_type = 'click' UNION ALL SELECT 'http', 'h' || event_id FROM events WHERE event_type = 'view' UNION ALL SELECT 'smb', NULL FROM events WHERE event_type = 'error') GROUP BY 1")
def honeypot_union(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ip = F.col("user_id").cast("string").alias("src_ip")
    a = e.where("event_type = 'click'").select(ip, F.lit("ssh").alias("honeypot_type"))
    b = e.where("event_type = 'view'").select(ip, F.lit("http").alias("honeypot_type"), F.concat(F.lit("h"), F.col("event_id").cast("string")).alias("payload_hash"))
    c = e.where("event_type = 'error'").select(ip, F.lit("smb").alias("honeypot_type"))
    return sessions.unify(a, b, c).groupBy("honeypot_type").agg(F.count("*").alias("n"), F.count("payload_hash").alias("hashed"))


@query("phishing_words", "SELECT conv_id, turn, contains(lower(text), 'phish') OR contains(lower(text), 'login') AS is_phishing FROM conversations")
def phishing_words(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", sessions.phishing(F.col("text"))["is_phishing"].alias("is_phishing"))


# ---------------------------------------------------------------- graphs

_GRAPH_EDGES = """SELECT 'f' || l_orderkey AS src, CASE l_linenumber % 4 WHEN 0 THEN 'p' || l_partkey WHEN 1 THEN 'w' || l_suppkey WHEN 2 THEN 'x' || l_suppkey ELSE 'y' || l_partkey END AS dst,
  CASE l_linenumber % 4 WHEN 0 THEN 'detected_in' WHEN 1 THEN 'maps_to' WHEN 2 THEN 'correlated_with' ELSE 'fixed_by' END AS type FROM lineitem"""


def graph_edges(spark, sf_dir) -> DataFrame:
    k = F.col("l_linenumber") % 4
    mark = lambda c, col: F.concat(F.lit(c), F.col(col).cast("string"))
    return table(spark, sf_dir, "lineitem").select(
        mark("f", "l_orderkey").alias("src"),
        F.when(k == 0, mark("p", "l_partkey")).when(k == 1, mark("w", "l_suppkey")).when(k == 2, mark("x", "l_suppkey")).otherwise(mark("y", "l_partkey")).alias("dst"),
        F.when(k == 0, "detected_in").when(k == 1, "maps_to").when(k == 2, "correlated_with").otherwise("fixed_by").alias("type"),
    )


@query("graph_score", f"""WITH e AS ({_GRAPH_EDGES}), a AS (SELECT src, max((type = 'maps_to')::INT) AS m, max((type = 'correlated_with')::INT) AS c, max((type = 'fixed_by')::INT) AS f FROM e GROUP BY src)
SELECT 'f' || o_orderkey AS id, coalesce(m * 30 + c * 40 + (1 - f) * 20, 0)::INTEGER AS score FROM orders LEFT JOIN a ON src = 'f' || o_orderkey""")
def graph_score(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").select(F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("id"))
    return graph.graph_scores(ids, graph_edges(spark, sf_dir))


@query("graph_stats", f"WITH e AS ({_GRAPH_EDGES}) SELECT 'nodes' AS what, count(*)::BIGINT AS n FROM nation UNION ALL SELECT 'edges', count(*)::BIGINT FROM e UNION ALL SELECT 'type:r' || n_regionkey, count(*)::BIGINT FROM nation GROUP BY n_regionkey")
def graph_stats(spark, sf_dir):
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("type"))
    return graph.graph_stats(nodes, graph_edges(spark, sf_dir))


@query("graph_valid_edges", "SELECT count(*)::BIGINT AS n FROM (SELECT n_nationkey AS src, n_nationkey + 20 AS dst FROM nation) WHERE dst IN (SELECT n_nationkey FROM nation)")
def graph_valid_edges(spark, sf_dir):
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"))
    edges = nodes.select(F.col("id").alias("src"), (F.col("id") + 20).alias("dst"))
    return graph.valid_edges(edges, nodes).agg(F.count("*").alias("n"))


@query("node_upsert", "SELECT user_id AS id, arg_max(event_type, event_id) AS type FROM events GROUP BY user_id")
def node_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("type"), F.col("event_id").alias("seq"))
    return graph.upsert_nodes(rows)


@query("attack_paths", """WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION ALL SELECT 'r' || r_regionkey, 'r' || (r_regionkey + 1) FROM region WHERE r_regionkey < 4),
w AS (SELECT 'n' || n_nationkey AS id, 'n' || n_nationkey AS cur, ['n' || n_nationkey] AS path FROM nation UNION ALL SELECT w.id, e.dst, list_append(path, e.dst) FROM w JOIN e ON w.cur = e.src WHERE NOT list_contains(path, e.dst))
SELECT id, array_to_string(path, '>') AS path FROM w WHERE cur NOT IN (SELECT src FROM e)""")
def attack_paths(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    mark = lambda c, col: F.concat(F.lit(c), col.cast("string"))
    edges = nation.select(mark("n", F.col("n_nationkey")).alias("src"), mark("r", F.col("n_regionkey")).alias("dst"))
    edges = edges.union(region.where("r_regionkey < 4").select(mark("r", F.col("r_regionkey")), mark("r", F.col("r_regionkey") + 1)))
    start = nation.select(mark("n", F.col("n_nationkey")).alias("id"))
    return graph.attack_paths(start, edges).select("id", F.array_join("path", ">").alias("path"))


@query("dependency_distances", """WITH RECURSIVE e AS (SELECT 's' || ps AS src, 'n' || n AS dst FROM (SELECT s_suppkey AS ps, s_nationkey AS n FROM supplier) UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION SELECT 'r' || r_regionkey, 'n' || ((r_regionkey * 7 + 3) % 25) FROM region),
w AS (SELECT 's' || s_suppkey AS start, 's' || s_suppkey AS id, 0 AS hops FROM supplier UNION SELECT w.start, e.dst, hops + 1 FROM w JOIN e ON w.id = e.src WHERE hops < 40)
SELECT start, id, min(hops)::INTEGER AS hops FROM w GROUP BY 1, 2""")
def dependency_distances(spark, sf_dir):
    mark = lambda c, col: F.concat(F.lit(c), col.cast("string"))
    nodes, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    edges = supplier.select(mark("s", F.col("s_suppkey")).alias("src"), mark("n", F.col("s_nationkey")).alias("dst")).union(nodes.select(mark("n", F.col("n_nationkey")), mark("r", F.col("n_regionkey"))))
    edges = edges.union(table(spark, sf_dir, "region").select(mark("r", F.col("r_regionkey")), mark("n", (F.col("r_regionkey") * 7 + 3) % 25)))
    return graph.distances(edges, supplier.select(mark("s", F.col("s_suppkey")).alias("id")))


@query("call_graph", """SELECT * FROM (VALUES ('handle', 'handle'), ('handle', 'fetch_user'), ('fetch_user', 'fetch_user'), ('fetch_user', 'execute'), ('idle', 'idle'), ('main', 'main'), ('main', 'show'), ('show', 'show')) AS t(src, dst)""")
def call_graph(spark, sf_dir):
    return graph.call_edges(graph.functions(spark.createDataFrame(list(APP), "file_path string, content string")))


@query("reachability", """WITH RECURSIVE e AS (SELECT * FROM (VALUES ('handle', 'fetch_user'), ('fetch_user', 'execute'), ('main', 'show')) AS t(src, dst)),
w AS (SELECT s AS source, s AS cur, [s] AS path FROM (VALUES ('handle'), ('main')) AS t(s) UNION ALL SELECT source, dst, list_append(path, dst) FROM w JOIN e ON cur = src WHERE NOT list_contains(path, dst))
SELECT source, cur AS sink, array_to_string(path, ' → ') AS path, len(path)::INTEGER AS length FROM w WHERE cur = 'fetch_user'""")
def reachability(spark, sf_dir):
    funcs = graph.functions(spark.createDataFrame(list(APP), "file_path string, content string"))
    paths = graph.shortest_paths(graph.call_edges(funcs), graph.sources(funcs), graph.sinks(funcs))
    return paths.select("source", "sink", F.array_join("path", " → ").alias("path"), "length")


@query("reachability_verdicts", """SELECT 'src/x.py' AS file_path, 'REACHABLE' AS status, 'handle → fetch_user' AS path UNION ALL SELECT 'app/web.py', 'REACHABLE', 'handle → fetch_user'""")
def reachability_verdicts(spark, sf_dir):
    files = spark.createDataFrame(list(APP), "file_path string, content string")
    funcs = graph.functions(files)
    found = spark.createDataFrame([("src/x.py",), ("app/web.py",)], "file_path string")
    return graph.verdicts(found, files, funcs, graph.call_edges(funcs)).select("file_path", "reachability.status", "reachability.path")


# ---------------------------------------------------------------- reports


@query("annotations", _with("""SELECT '::' || CASE WHEN severity = 'critical' THEN 'error' ELSE 'warning' END || ' file=' || file_path || ',line=' || line || ',col=' || "column" || '::' || rule_id || ': ' || message AS text FROM findings"""))
def annotations(spark, sf_dir):
    return reports.annotations(prose_findings(spark, sf_dir))


@query("diagnostics", _with("""SELECT file_path, line - 1 AS line, "column" - 1 AS start, least("column" - 1 + length, length(line_text))::INTEGER AS "end", cwe AS code FROM findings"""))
def diagnostics(spark, sf_dir):
    return reports.diagnostics(prose_findings(spark, sf_dir)).select("file_path", "line", "start", "end", "code")


@query("sarif_results", _with("""SELECT rule_id, CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'low' THEN 'note' ELSE 'warning' END AS level, file_path AS uri, line AS start_line FROM findings"""))
def sarif_results(spark, sf_dir):
    j = F.col("json")
    rows = reports.sarif_results(prose_findings(spark, sf_dir))
    at = "$.locations[0].physicalLocation."
    return rows.select(F.get_json_object(j, "$.ruleId").alias("rule_id"), F.get_json_object(j, "$.level").alias("level"), F.get_json_object(j, at + "artifactLocation.uri").alias("uri"), F.get_json_object(j, at + "region.startLine").cast("int").alias("start_line"))


@query("sonar_issues", _with("SELECT rule_id, upper(severity) AS severity, file_path FROM findings"))
def sonar_issues(spark, sf_dir):
    j = F.col("json")
    rows = reports.sonar_issues(prose_findings(spark, sf_dir))
    return rows.select(F.get_json_object(j, "$.ruleId").alias("rule_id"), F.get_json_object(j, "$.severity").alias("severity"), F.get_json_object(j, "$.primaryLocation.filePath").alias("file_path"))


@query("json_findings", _with("SELECT rule_id, file_path, 'false' AS requires_api FROM findings"))
def json_findings(spark, sf_dir):
    j = F.col("json")
    rows = reports.finding_json(prose_findings(spark, sf_dir))
    return rows.select(F.get_json_object(j, "$.rule_id").alias("rule_id"), F.get_json_object(j, "$.file_path").alias("file_path"), F.get_json_object(j, "$.intelligence.requires_api").alias("requires_api"))


@query("quick_fixes", _with(f"""SELECT file_path, line, 'Accept: ' || rule_id AS title, line_text || '  // sastra-ignore: ' || rule_id AS new_line FROM findings
UNION ALL SELECT file_path, line, 'Fix: ' || rule_id, substr(line_text, 1, "column" - 1) || {sql_text(SECRET.example.split("Good: ")[1])} || substr(line_text, "column" + length) FROM findings WHERE rule_id = {sql_text(SECRET.type)}"""))
def quick_fixes(spark, sf_dir):
    return reports.quick_fix(prose_findings(spark, sf_dir))


@query("detail_texts", f"SELECT rule_id, 'WHY: ' || explanation || chr(10) || 'FIX: ' || fix || chr(10) || 'EXAMPLE: ' || good || chr(10) || 'REFERENCE: ' || cwe || ' https://cwe.mitre.org/data/definitions/' || replace(cwe, 'CWE-', '') || '.html' AS text FROM (VALUES {_ADVICE}) AS t(rule_id, explanation, fix, good, cwe)")
def detail_texts(spark, sf_dir):
    rows = rules.rules_frame(spark).withColumnRenamed("type", "rule_id")
    return rows.select("rule_id", reports.detail_text(rows).alias("text"))


@query("report_lines", _with(f"""SELECT 0 AS n, '{{"tool": "Sastra", "scan_path": "corpus", "timestamp": "now", "total": ' || count(*) || ', "findings": [' AS text FROM findings UNION ALL SELECT count(*) + 1, ']}}' FROM findings
UNION ALL SELECT n, CASE WHEN n > 1 THEN ',' ELSE '' END || rule_id || ' ' || file_path || ':' || line FROM (SELECT *, row_number() OVER (ORDER BY {_RANK4}, severity, file_path, line, "column", rule_id) AS n FROM findings)"""))
def report_lines(spark, sf_dir):
    rows = reports.report_lines("json", prose_findings(spark, sf_dir), "corpus", "now")
    j = F.ltrim("text", F.lit(","))
    short = F.concat(F.when(F.col("text").startswith(","), ",").otherwise(""), F.get_json_object(j, "$.rule_id"), F.lit(" "), F.get_json_object(j, "$.file_path"), F.lit(":"), F.get_json_object(j, "$.line"))
    return rows.select("n", F.coalesce(short, "text").alias("text"))


@query("inspections", f"SELECT regexp_replace(rule_id, '\\s', '', 'g') AS inspection_id, CASE severity WHEN 'critical' THEN 'ERROR' WHEN 'high' THEN 'ERROR' WHEN 'medium' THEN 'WARNING' WHEN 'low' THEN 'WEAK_WARNING' ELSE 'INFO' END AS severity FROM (VALUES {_CATALOG}) AS t(rule_ord, rule_id, severity, regex, languages, cwe)")
def inspections(spark, sf_dir):
    return reports.inspections(rules.rules_frame(spark)).select("inspection_id", "severity")


@query("training_rows", f"SELECT 'rule' AS kind, count(*)::BIGINT AS n FROM (VALUES {_CATALOG}) AS t(rule_ord, rule_id, severity, regex, languages, cwe) UNION ALL SELECT 'example', count(*)::BIGINT FROM benchmark")
def training_rows(spark, sf_dir):
    labelled = table(spark, sf_dir, "benchmark").select(F.col("text").alias("code"), F.lit("safe").alias("label"))
    rows = reports.training_rows(rules.rules_frame(spark), labelled)
    return rows.groupBy(F.when(F.col("output") == "safe", "example").otherwise("rule").alias("kind")).agg(F.count("*").alias("n"))


@query("chat_rows", "SELECT '<|im_start|>user' || chr(10) || 'Analyze this code for security vulnerabilities' || chr(10) || chr(10) || 'Code:' || chr(10) || coalesce(substr(text, 1, 200), '') || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || 'safe<|im_end|>' AS text FROM benchmark")
def chat_rows(spark, sf_dir):
    labelled = table(spark, sf_dir, "benchmark").select(F.col("text").alias("code"), F.lit("safe").alias("label"))
    return reports.chat_rows(reports.training_rows(rules.rules_frame(spark).limit(0), labelled))


@query("model_answers", "SELECT doc_id, 'high' AS severity, least(greatest(doc_id % 9 - 1, 0), 4)::INTEGER AS line FROM documents WHERE doc_id % 2 = 0")
def model_answers(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('Answer: [{"type":"t","severity":"HIGH","line":'), (F.col("doc_id") % 9).cast("string"), F.lit("}] end"))).otherwise("none")
    rows = reports.model_findings(d.select(F.col("doc_id").cast("string").alias("file_path"), F.lit(5).alias("lines"), raw.alias("raw")))
    return rows.select(F.col("file_path").cast("long").alias("doc_id"), "severity", "line")
