"""Line heuristics by file suffix, and the secret layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import entropy, explode_lines, is_test_path, suffix
from .hits import TYPE, explode_hits, hit
from .rules import may_match

# Ours: families of structured secrets, by the public prefixes of their vendors.
SECRET_FAMILIES = (
    ("AWS Access Key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("GitHub Token", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b"),
    ("Slack Token", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    ("Google API Key", r"\bAIza[0-9A-Za-z_-]{35}"),
    ("Stripe Key", r"\b[sr]k_live_[0-9A-Za-z]{20,}"),
    ("Private Key Block", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
    ("JSON Web Token", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
#: Ours: a quoted value of at least so many characters with at least so many bits a character is a secret, whatever its name.
LEAST_LENGTH, LEAST_BITS = 20, 3.5
QUOTED = r"""["']([A-Za-z0-9+/=_-]{20,})["']"""


WEB, NATIVE = (".js", ".ts", ".jsx", ".tsx"), (".go", ".rs")


def heuristic_hits(path: Column, line: Column) -> Column:
    """GEN-1..4: innerHTML constants, eval of user input, Sprintf queries, unsafe blocks; column 1, length of the line."""
    low, ends = F.lower(path), suffix(path)
    web = ends.isin(*WEB)
    spec = low.contains(".test.") | low.contains("spec.")
    sure = lambda c: F.when(is_test_path(path), "low").otherwise(c)
    rule = lambda name, severity, cwe, confidence, sink, message: hit(rule_id=name, severity=severity, cwe=cwe, confidence=sure(confidence), sink=sink, message=message, column=1, length=F.length(line), analyzer="ast", layer_ord=3)
    return F.array_compact(
        F.array(
            F.when(web & line.contains("innerHTML") & ~spec & line.contains("const ") & line.contains("=") & ~F.lower(line).contains("trusted"), rule("XSS: innerHTML (line)", "high", "CWE-79", "medium", "innerHTML", "Markup of an element is set in this line")),
            F.when(web & line.rlike(r"(?i)eval\s*\(\s*[^)]*\b(?:req|input|param|query|body|user)"), rule("eval() with user input (line)", "critical", "CWE-95", "high", "eval()", "eval runs text that names user input")),
            F.when((ends == ".go") & line.rlike(r"(?i)(?:db\.Query|db\.Exec|db\.QueryRow)\s*\(\s*fmt\.Sprintf"), rule("Go: SQL Injection (line)", "critical", "CWE-89", "high", None, "The statement comes from a format call")),
            F.when((ends == ".rs") & line.contains("unsafe") & line.contains("{"), rule("Rust: Unsafe Block (line)", "high", "CWE-119", "medium", None, "Compiler checks are switched off in this block")),
        )
    ).cast(TYPE)


def heuristic_findings(files: DataFrame) -> DataFrame:
    """GEN-0: the line heuristics over files of their suffixes."""
    rows = explode_lines(files.where(suffix(F.col("file_path")).isin(*WEB, *NATIVE)))
    return explode_hits(rows, heuristic_hits(F.col("file_path"), F.col("line_text")))


def _quotes(line: Column) -> Column:
    return line.contains('"') | line.contains("'")


def quotes_or_secret(line: Column) -> Column:
    """A cheap test that holds for every line with a hit of :func:`secret_hits`."""
    out = _quotes(line) & line.rlike(QUOTED)
    for _, p in SECRET_FAMILIES:
        out = out | (may_match(line, p, cased=True) & line.rlike(p))
    return out


def secret_hits(line: Column) -> Column:
    """SEC-1 (ours): structured secrets and quoted values of high entropy. The value itself never leaves this operator."""
    secret = lambda name, at, n: hit(rule_id=f"Secret: {name}", severity="critical", cwe="CWE-798", confidence="high", message="Secret value in source", column=at, length=n, analyzer="secret", layer_ord=4)
    families = [F.when(may_match(line, p, cased=True) & line.rlike(p), secret(name, F.regexp_instr(line, F.lit(p)), F.length(F.regexp_substr(line, F.lit(p))))) for name, p in SECRET_FAMILIES]
    value = F.when(_quotes(line), F.regexp_extract(line, QUOTED, 1)).otherwise("")
    random = F.when((F.length(value) >= LEAST_LENGTH) & (entropy(value) >= LEAST_BITS), secret("High Entropy Value", F.regexp_instr(line, F.lit(QUOTED)) + 1, F.length(value)))
    return F.array_compact(F.array(*families, random)).cast(TYPE)


def secret_findings(files: DataFrame) -> DataFrame:
    """SEC-1 over files that aren't tests."""
    rows = explode_lines(files.where(~is_test_path(F.col("file_path")))).where(quotes_or_secret(F.col("line_text")))
    return explode_hits(rows, secret_hits(F.col("line_text")))
