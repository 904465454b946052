"""Report writers. Rows are rendered by column expressions on the executors, in an order that no task holds as a whole.

:func:`write_report` has the executors write a report as ordered parts, however large; :func:`report_text` joins the same pieces on the driver, for reports that
people read. Times are parameters, so that a report can be repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import numbered
from ..functions.text import REPORT_RANK, escape, language_of, lookup, severity_rank
from ..operators.findings import COLUMNS, in_order
from ..operators.rules import CATALOG

TOOL, VERSION = "Sastra", "0.2.0"
# Report levels.
SARIF_LEVEL = {"critical": "error", "high": "error", "medium": "warning", "low": "note"}
SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"
INSPECTION = {"critical": "ERROR", "high": "ERROR", "medium": "WARNING", "low": "WEAK_WARNING"}
COMMENT = {"python": "#", "ruby": "#", "javascript": "//", "typescript": "//", "java": "//", "php": "//", "go": "//", "rust": "//", "c": "//", "cpp": "//", "csharp": "//"}
KEEP_NULLS = {"ignoreNullFields": "false"}


def _ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy(severity_rank(F.col("severity"), REPORT_RANK), "severity", "file_path", "line", "column", "rule_id")


def cwe_url(cwe: Column) -> Column:
    """SNK-14."""
    return F.concat(F.lit("https://cwe.mitre.org/data/definitions/"), F.replace(cwe, F.lit("CWE-"), F.lit("")), F.lit(".html"))


def _finding_object(explanation: str) -> Column:
    part = F.struct(F.lit("offline").alias("method"), F.lit(TOOL.lower()).alias("source"), F.lit(False).alias("requires_api")).alias("intelligence")
    cols = [F.col(c) if c != "explanation" else F.col(explanation).alias(c) for c in COLUMNS]
    return F.to_json(F.struct(*cols, part), KEEP_NULLS)


def finding_json(findings: DataFrame, explanation: str = "explanation") -> DataFrame:
    """PRJ-5: (json) one object a finding, nulls kept, with the constant part that says no service was asked."""
    return findings.select(_finding_object(explanation).alias("json"))


def _sarif_object() -> Column:
    region = F.struct(F.col("line").alias("startLine"), F.col("column").alias("startColumn")).alias("region")
    place = F.struct(F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), region).alias("physicalLocation"))
    result = F.struct(
        F.col("rule_id").alias("ruleId"), lookup(F.col("severity"), SARIF_LEVEL, "warning").alias("level"), F.struct(F.col("message").alias("text")).alias("message"),
        F.array(place).alias("locations"), F.struct("cwe", "fix", "confidence").alias("properties"),
    )
    return F.to_json(result, KEEP_NULLS)


def sarif_results(findings: DataFrame) -> DataFrame:
    """SNK-3: (json) one SARIF result a finding."""
    return findings.select(_sarif_object().alias("json"))


def _json_text(x) -> str:
    import json

    return json.dumps(x, ensure_ascii=False)


def _title(line: str, rest: str = "") -> Column:
    """``line`` with {S} and {N} for the severity in capitals and its group's size, before a group's first finding."""
    name = F.upper(F.coalesce("severity", F.lit("unknown")))
    text = F.replace(F.replace(F.lit(line), F.lit("{S}"), name), F.lit("{N}"), F.col("n").cast("string"))
    return F.when(F.col("nth") == 1, F.concat(text, F.lit(rest))).otherwise("")


def _place(*between: str) -> Column:
    parts = [F.col("file_path"), F.col("line").cast("string"), F.col("column").cast("string")][: len(between) + 1]
    return F.concat(parts[0], *[x for mark, part in zip(between, parts[1:], strict=True) for x in (F.lit(mark), part)])


def _json_kind(path, now, total):
    """SNK-2, SNK-7."""
    head = f'{{"tool": {_json_text(TOOL)}, "scan_path": {_json_text(path)}, "timestamp": {_json_text(now)}, "total": {total}, "findings": ['
    return head, F.concat(F.when(F.col("at") > 1, ",").otherwise(""), _finding_object("explanation")), "]}"


def _sarif_kind(path, now, total):
    """SNK-3."""
    driver = _json_text({"driver": {"name": TOOL, "semanticVersion": VERSION}})
    head = f'{{"$schema": "{SARIF_SCHEMA}", "version": "2.1.0", "runs": [{{"tool": {driver}, "results": ['
    return head, F.concat(F.when(F.col("at") > 1, ",").otherwise(""), _sarif_object()), "]}]}"


def _text_kind(path, now, total):
    """SNK-1."""
    if not total:
        return f"{TOOL} scan of {path}\nNo security issues found.", F.lit(""), ""
    cwe = F.when(F.coalesce("cwe", F.lit("")) != "", F.concat(F.lit("\n  CWE: "), "cwe")).otherwise("")
    piece = F.concat(_title("{S} ({N})\n" + "-" * 60 + "\n"), F.lit("  "), _place(":", ":"), F.lit("\n  Rule: "), "rule_id", F.lit("\n  Message: "), F.coalesce("message", F.lit("")), cwe, F.lit("\n"))
    return f"{TOOL} Scan Report — {path}\n{'=' * 60}\n", piece, ""


def _markdown_kind(path, now, total):
    """SNK-4."""
    cwe = F.when(F.coalesce("cwe", F.lit("")) != "", F.concat(F.lit("\n- **CWE:** ["), "cwe", F.lit("]("), cwe_url(F.col("cwe")), F.lit(")"))).otherwise("")
    piece = F.concat(_title("## {S} ({N})\n\n"), F.lit("### "), "rule_id", F.lit("\n- **File:** `"), _place(":"), F.lit("`\n- **Message:** "), F.coalesce("message", F.lit("")), cwe, F.lit("\n- **Fix:** "), F.coalesce("fix", F.lit("")), F.lit("\n"))
    return f"# {TOOL} Scan Report — `{path}`\n\n**Total findings:** {total}  \n**Scanned at:** {now}\n", piece, ""


def _html_kind(path, now, total):
    """SNK-5: all values escaped."""
    from html import escape as plain

    fix = F.when(F.coalesce("fix", F.lit("")) != "", F.concat(F.lit("<p class='fix'>Fix: "), escape(F.col("fix")), F.lit("</p>"))).otherwise("")
    card = F.concat(
        _title("<h2>{S} ({N})</h2>\n"), F.lit("<div class='finding "), escape(F.col("severity")), F.lit("'><b>"), escape(F.upper("severity")), F.lit("</b> "), escape(F.col("rule_id")), F.lit(" <i>"), escape(F.col("cwe")), F.lit("</i><p>"),
        escape(_place(":", ":")), F.lit("</p><p>"), escape(F.col("message")), F.lit("</p>"), fix, F.lit("</div>"),
    )
    head = f"<!DOCTYPE html>\n<html lang='en'><head><meta charset='UTF-8'><title>{TOOL} Report — {plain(path)}</title></head><body>\n<h1>{TOOL} Security Report</h1><p>Scan: <code>{plain(path)}</code></p>"
    return head, card, f"<p class='timestamp'>{plain(now)}</p></body></html>"


KINDS = {"text": _text_kind, "json": _json_kind, "sarif": _sarif_kind, "markdown": _markdown_kind, "html": _html_kind}


def report_lines(kind: str, findings: DataFrame, scan_path: str = "", timestamp: str = "") -> DataFrame:
    """(n, text): a report's head (0), a piece for each finding in order, and its foot."""
    rows = in_order(findings)
    total = rows.count()  # of the numbered rows: counting the findings would run the scan again
    head, piece, foot = KINDS[kind](scan_path, timestamp, total)
    ends = findings.sparkSession.createDataFrame([(0, head), (total + 1, foot)], "n long, text string").where("n = 0 or text <> ''")
    return rows.select(F.col("at").alias("n"), piece.alias("text")).union(ends)


def write_report(kind: str, findings: DataFrame, path: str, scan_path: str = "", timestamp: str = "") -> None:
    """The report as text files below ``path`` that executors write; joined in the order of their names they are the report. An earlier report is replaced."""
    report_lines(kind, findings, scan_path, timestamp).orderBy("n").select("text").write.mode("overwrite").text(path)


def report_pieces(kind: str, findings: DataFrame, scan_path: str = "", timestamp: str = "") -> Iterator[str]:
    """The report's pieces in order, a partition at a time."""
    return (r["text"] for r in report_lines(kind, findings, scan_path, timestamp).orderBy("n").select("text").toLocalIterator())


def report_text(kind: str, findings: DataFrame, scan_path: str = "", timestamp: str = "") -> str:
    """The whole report on the driver, for one that people read."""
    return "\n".join(report_pieces(kind, findings, scan_path, timestamp)) + "\n"


def editor_report(findings: DataFrame) -> str:
    """SNK-12: totals and numbered findings by severity, lines from 1."""
    sizes = {r["severity"]: r["n"] for r in findings.groupBy("severity").agg(F.count("*").alias("n")).collect()}  # one row a severity
    if not sizes:
        return "No security vulnerabilities detected!"
    out = ["SECURITY SCAN REPORT", "=" * 50, "", f"Total Issues Found: {sum(sizes.values())}", *[f"  {s.title()}: {sizes.get(s, 0)}" for s in REPORT_RANK], ""]
    last, n = None, 0
    for r in _ordered(findings.where(F.col("severity").isin(*REPORT_RANK))).select("severity", "rule_id", "line", "message").toLocalIterator():
        if r["severity"] != last:
            last, n = r["severity"], 0
            out.append(f"{last.upper()} SEVERITY:")
        n += 1
        out += [f"  {n}. {r['rule_id']} (Line {r['line']})", f"     {r['message']}"]
    return "\n".join(out)


def learn_more(findings: DataFrame) -> DataFrame:
    """SNK-14: (html) what an editor shows of a finding, escaped, with the weakness's address."""
    link = F.when(F.col("cwe").isNotNull(), F.concat(F.lit("<a href='"), cwe_url(F.col("cwe")), F.lit("'>"), escape(F.col("cwe")), F.lit("</a>"))).otherwise("")
    return findings.select(F.concat(F.lit("<h1>"), escape(F.col("rule_id")), F.lit("</h1><p>"), escape(F.col("message")), F.lit("</p><p>"), escape(F.col("explanation")), F.lit("</p><p>"), escape(F.col("fix")), F.lit("</p>"), link).alias("html"))


def feedback_report(scored: DataFrame, timestamp: str) -> str:
    """INT-6: totals, bands, the three most frequent vectors and the five most frequent tactics of findings after ``knowledge.feedback``."""
    from ..operators.findings import top_words
    from ..operators.knowledge import feedback_summary

    t = feedback_summary(scored).first()
    vectors = top_words(scored.select("attack_vector"), "attack_vector", 3).collect()
    tactics = top_words(scored.select(F.explode("tactics").alias("tactic")), "tactic", 5).collect()
    lines = ["Threat Feedback Report", "", f"Total findings: {t['total']}", f"Critical (>=80): {t['critical']}", f"High (60-79): {t['high']}", "", "Top attack vectors:", *[f"  {v}: {n} findings" for v, n in vectors], "", "Top MITRE tactics:", *[f"  {v}: {n} findings" for v, n in tactics]]
    return "\n".join([*lines, "", f"Generated: {timestamp}"])


def commit_verdict(findings: DataFrame) -> int:
    """SNK-15: 1 if a commit holds a critical or high finding, else 0."""
    return int(not findings.where(F.col("severity").isin("critical", "high")).limit(1).isEmpty())


def annotations(findings: DataFrame, level: str = "warning") -> DataFrame:
    """FLT-12, SNK-6: (text) one annotation line a finding; at level 'error' only critical ones."""
    kind = F.when(F.col("severity") == "critical", "error").otherwise("warning")
    rows = findings.where(kind == "error") if level == "error" else findings
    return rows.select(F.format_string("::%s file=%s,line=%d,col=%d::%s: %s", kind, "file_path", "line", "column", "rule_id", "message").alias("text"))


def slack_payload(findings: DataFrame) -> dict:
    """SNK-8: the message's blocks; sending is left to the caller."""
    counts = {r["severity"]: r["n"] for r in findings.groupBy("severity").agg(F.count("*").alias("n")).collect()}  # one row a severity
    fields = [{"type": "mrkdwn", "text": f"*{s.title()}:* {counts.get(s, 0)}"} for s in REPORT_RANK]
    blocks = [{"type": "header", "text": {"type": "plain_text", "text": f"{TOOL} Scan — {sum(counts.values())} findings"}}, {"type": "section", "fields": fields}]
    line = F.concat(F.lit("• "), "file_path", F.lit(":"), F.col("line").cast("string"), F.lit(" — "), "message")
    top = [r[0] for r in _ordered(findings.where(F.col("severity").isin("critical", "high"))).select(line).limit(5).collect()]
    if top:
        blocks.append({"type": "section", "text": {"type": "mrkdwn", "text": "*Top findings:*\n" + "\n".join(top)}})
    return {"blocks": blocks}


def sonar_issues(findings: DataFrame) -> DataFrame:
    """SNK-9: (json) generic issues."""
    place = F.struct("message", F.col("file_path").alias("filePath"), F.struct(F.col("line").alias("startLine"), F.col("column").alias("startColumn")).alias("textRange"))
    issue = F.struct(F.lit(TOOL.lower()).alias("engineId"), F.col("rule_id").alias("ruleId"), F.upper("severity").alias("severity"), F.lit("VULNERABILITY").alias("type"), place.alias("primaryLocation"))
    return findings.select(F.to_json(issue, KEEP_NULLS).alias("json"))


def junit_report(findings: DataFrame, cases: int = 50) -> str:
    """SNK-10, LIM-2: the first ``cases`` cases, totals over all."""
    name = F.concat(escape(F.col("rule_id")), F.lit(" — "), escape(F.col("file_path")), F.lit(":"), F.col("line").cast("string"))
    case = F.concat(F.lit('    <testcase name="'), name, F.lit('">\n      <failure message="'), escape(F.col("message")), F.lit('" type="'), "severity", F.lit('">'), escape(F.col("explanation")), F.lit("</failure>\n    </testcase>"))
    t = findings.agg(F.count("*").alias("n"), F.count_if(F.col("severity").isin("critical", "high")).alias("f")).first()
    body = [r[0] for r in _ordered(findings).select(case).limit(cases).collect()]
    return "\n".join(['<?xml version="1.0" encoding="UTF-8"?>', f'<testsuite name="{TOOL}" tests="{t["n"]}" failures="{t["f"]}">', *body, "</testsuite>"])


def remediation_plan(ordered: DataFrame) -> DataFrame:
    """INT-5: (n, text) the numbered plan lines, by severity and then surest first; a head where the severity changes, fixes cut to 120 characters.

    Lines are numbered range by range; what is known of a severity is where it begins, one row each.
    """
    rank = severity_rank(F.col("severity"), REPORT_RANK)
    sure = lookup(F.col("confidence"), {"high": 0, "medium": 1, "low": 2}, 3)
    rows = numbered(ordered.withColumn("__r", rank).withColumn("__c", sure), "__r", "__c", "file_path", "line", "rule_id", "column")
    first = rows.groupBy("__r").agg(F.min("n").alias("__first"))
    rows = rows.join(F.broadcast(first), "__r")  # one row a rank
    head = F.when(F.col("n") == F.col("__first"), F.concat(F.upper("severity"), F.lit(" PRIORITY\n"))).otherwise("")
    fix = F.when(F.coalesce("fix", F.lit("")) != "", F.concat(F.lit("\n   Fix: "), F.substring("fix", 1, 120))).otherwise("")
    return rows.select("n", F.concat(head, F.col("n").cast("string"), F.lit(". "), "rule_id", F.lit("\n   File: "), "file_path", F.lit(":"), F.col("line").cast("string"), fix).alias("text"))


# ---------------------------------------------------------------- editor


def diagnostics(findings: DataFrame) -> DataFrame:
    """PRJ-6: ranges from 0 that end at the line's end at most, the weakness as code, a tag for deprecated and weak things. Takes findings with line_text."""
    start = F.col("column") - 1
    return findings.select(
        "file_path", (F.col("line") - 1).alias("line"), start.alias("start"), F.least(start + F.col("length"), F.length("line_text")).alias("end"), F.col("cwe").alias("code"),
        lookup(F.col("severity"), {"critical": "error", "high": "error", "medium": "warning", "low": "information"}, "warning").alias("level"), "message",
        F.when(F.col("rule_id").contains("Deprecated") | F.col("rule_id").contains("Weak"), "deprecated").alias("tag"), F.lit(TOOL).alias("source"),
    )


def own_diagnostics(rows: DataFrame) -> DataFrame:
    """FLT-15: an editor's diagnostics that come from here."""
    return rows.where(F.col("source") == TOOL)


def example_of(rule: Column) -> Column:
    """The example of a catalog rule, or null."""
    return lookup(rule, {r.type: r.example for r in CATALOG})


def detail_text(findings: DataFrame) -> Column:
    """PRJ-7: why, fix, example and reference; parts without content are left out."""
    part = lambda title, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{title}: "), c))
    example = F.col("example") if "example" in findings.columns else example_of(F.col("rule_id"))
    return F.concat_ws("\n", part("WHY", F.col("explanation")), part("FIX", F.col("fix")), part("EXAMPLE", good_example(example)), F.when(F.col("cwe").isNotNull(), F.concat(F.lit("REFERENCE: "), F.col("cwe"), F.lit(" "), cwe_url(F.col("cwe")))))


def inspections(rules: DataFrame) -> DataFrame:
    """PRJ-8: rules for another editor's inspections."""
    return rules.select(F.regexp_replace("type", r"\s", "").alias("inspection_id"), lookup(F.col("severity"), INSPECTION, "INFO").alias("severity"), "regex", F.array_join("languages", ",").alias("languages"))


def good_example(example: Column) -> Column:
    """SNK-13: what a rule's example shows after 'Good:', or ''."""
    return F.trim(F.regexp_extract(example, r"(?s)Good:\s*(.*)\z", 1))


def apply_fix(line: Column, column: Column, length: Column, text: Column) -> Column:
    """SNK-13: the line with its match replaced."""
    return F.overlay(line, text, column, length)


def ignore_comment(language: Column, rule: Column) -> Column:
    """SNK-13: the comment that marks a finding as accepted."""
    return F.concat(lookup(language, COMMENT, "//"), F.lit(f" {TOOL.lower()}-ignore: "), rule)


def training_rows(rules: DataFrame, labelled: DataFrame) -> DataFrame:
    """PRJ-9: (instruction, input, output): rules with texts cut to 200 characters, and labelled examples (code, label)."""
    ask = F.lit("Analyze this code for security vulnerabilities")
    a = rules.select(ask.alias("instruction"), F.substring("regex", 1, 200).alias("input"), F.concat("type", F.lit(" ("), "severity", F.lit("): "), F.substring("message", 1, 200)).alias("output"))
    return a.union(labelled.select(ask, F.substring("code", 1, 200), F.col("label")))


def chat_rows(rows: DataFrame) -> DataFrame:
    """PRJ-9: (text) training rows in the chat form with turn marks that instruction models are tuned on."""
    return rows.select(F.format_string("<|im_start|>user\n%s\n\nCode:\n%s<|im_end|>\n<|im_start|>assistant\n%s<|im_end|>", *[F.coalesce(c, F.lit("")) for c in ("instruction", "input", "output")]).alias("text"))


def quick_fix(findings: DataFrame) -> DataFrame:
    """SNK-13: (file_path, line, title, new_line) edits of findings with line_text: the match replaced by the good form of the rule's example, and a comment that accepts the finding."""
    good = good_example(example_of(F.col("rule_id")))
    edit = findings.where(good != "").select("file_path", "line", F.concat(F.lit("Fix: "), "rule_id").alias("title"), apply_fix(F.col("line_text"), F.col("column"), F.col("length"), good).alias("new_line"))
    language = F.col("language") if "language" in findings.columns else language_of(F.col("file_path"))
    accept = findings.select("file_path", "line", F.concat(F.lit("Accept: "), "rule_id").alias("title"), F.concat("line_text", F.lit("  "), ignore_comment(language, F.col("rule_id"))).alias("new_line"))
    return edit.union(accept)


def salvage(raw: Column, schema: str) -> Column:
    """AI-5: the object between the first and the last brace of a model's answer, or null."""
    return F.from_json(F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.lit("")), schema)


def model_findings(answers: DataFrame) -> DataFrame:
    """AI-4: (file_path, lines, raw) answers as findings: severity medium if unknown, line within the file, column 0, length 100."""
    schema = "array<struct<type:string,severity:string,line:int,message:string,explanation:string,fix:string,cwe:string>>"
    rows = answers.select("file_path", "lines", F.explode(F.from_json(F.regexp_extract("raw", r"(?s)\[.*\]", 0), schema)).alias("a"))
    severity = F.when(F.lower("a.severity").isin("critical", "high", "medium", "low"), F.lower("a.severity")).otherwise("medium")
    line = F.greatest(F.lit(0), F.least(F.coalesce("a.line", F.lit(1)) - 1, F.col("lines") - 1))
    return rows.select(F.coalesce("a.type", F.lit("unknown")).alias("rule_id"), severity.alias("severity"), "file_path", line.alias("line"), F.lit(0).alias("column"), F.lit(100).alias("length"), F.coalesce("a.message", F.lit("")).alias("message"), "a.explanation", "a.fix", "a.cwe", F.lit("ai").alias("analyzer"))
