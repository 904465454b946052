"""Column functions over paths, lines and severities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# File suffix to language.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".tsx": "typescript", ".jsx": "javascript", ".java": "java",
    ".php": "php", ".go": "go", ".rs": "rust", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".c": "c", ".cs": "csharp",
    ".rb": "ruby", ".swift": "swift", ".kt": "kotlin",
}
# Severity to rank, and the four-level rank of text reports and gates.
SEVERITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4}
REPORT_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3}
UNKNOWN_RANK = 9


def lookup(column: Column, table: dict, default=None) -> Column:
    """A literal map looked up by ``column``; ``default`` (null) for other keys."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    found = F.try_element_at(pairs, column)
    return found if default is None else F.coalesce(found, default if isinstance(default, Column) else F.lit(default))


def escape(text: Column) -> Column:
    """Markup-safe text; null becomes empty."""
    out = F.coalesce(text, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def suffix(path: Column) -> Column:
    """The lower-cased suffix with its dot; '' for none, as for a name that only begins with a dot."""
    return F.lower(F.regexp_extract(basename(path), r"(?s)\A.+(\.[^.]+)\z", 1))


def language_of(path: Column) -> Column:
    """PRJ-1: language by suffix, else the suffix without its dot."""
    s = suffix(path)
    return lookup(s, LANGUAGES, F.ltrim(s, F.lit(".")))


def is_test_path(path: Column) -> Column:
    """FLT-3: test, generated, documentation or vendored file."""
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    name = F.element_at(F.split(p, "/"), -1)
    by_name = name.startswith("test_") | name.startswith("conftest.") | name.contains("_test.") | name.contains(".test.") | name.contains("spec_")
    return by_name | p.rlike("/(tests|test|__pycache__|fixtures|examples|docs|vendor|node_modules)/")


def is_syntax_test_path(path: Column) -> Column:
    """FLT-4: the looser test of the syntax-tree layer, on the whole path."""
    p = F.lower(path)
    return p.contains("test_") | p.contains("_test") | p.contains("/tests/") | p.contains("conftest")


def severity_rank(severity: Column, table: dict = SEVERITY_RANK) -> Column:
    return lookup(severity, table, UNKNOWN_RANK)


def normalise(content: Column) -> Column:
    """Universal newlines; bytes that weren't text (U+FFFD after decoding) are dropped."""
    unix = F.replace(F.replace(content, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.replace(unix, F.lit("\ufffd"), F.lit(""))


def explode_lines(files: DataFrame, content: str = "content", keep_last_empty: bool = False) -> DataFrame:
    """PRJ-2: one row a line: ``line`` from 1, ``line_text`` without and ``raw_line`` with its newline.

    The Python contract has no final empty line, the editor's has; an empty file has no line in the first. Texts are cut at
    newlines, one plain character, and all but the last get theirs back; the file's text doesn't travel with its lines.
    """
    kept = [c for c in files.columns if c != content]
    pieces = F.split(normalise(F.coalesce(F.col(content), F.lit(""))), "\n", -1)
    rows = files.select(*kept, pieces.alias("__pieces")).select(*kept, F.size("__pieces").alias("__n"), F.posexplode("__pieces").alias("__p", "line_text"))
    line = F.col("__p") + 1
    if not keep_last_empty:
        rows = rows.where((line < F.col("__n")) | (F.col("line_text") != ""))
    return rows.select(*kept, line.alias("line"), "line_text", F.when(line < F.col("__n"), F.concat("line_text", F.lit("\n"))).otherwise(F.col("line_text")).alias("raw_line"))


def line_count(content: Column) -> Column:
    return F.size(F.split(content, "\n", -1))


def entropy(text: Column) -> Column:
    """Shannon entropy in bits of a string's characters; 0 for an empty one."""
    n = F.length(text)
    counts = F.transform(F.array_distinct(F.split(text, "")), lambda c: (n - F.length(F.replace(text, c, F.lit("")))).cast("double"))
    bits = F.aggregate(F.filter(counts, lambda c: c > 0), F.lit(0.0), lambda acc, c: acc - c / n * F.log2(c / n))
    return F.when(n > 0, bits).otherwise(0.0)


def python_round(value: Column, digits: int) -> Column:
    """Half-even rounding, the rounding of scores."""
    return F.bround(value, digits)
