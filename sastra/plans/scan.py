"""The scan: layers over a corpus, united, made unique, filtered and ranked, as one lazy plan."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import explode_lines, is_test_path, suffix
from ..functions.workers import ship
from ..operators import calls, findings, heuristics, hits, python_ast, rules
from ..sinks.reports import TOOL

#: A plugin takes a path and a text and returns findings as dicts; it may also say which languages it knows.
Plugin = Callable[[str, str], Iterable[dict]]


def line_layers(files: DataFrame, severities: Sequence[str] | None = None, custom=()) -> DataFrame:
    """The three line layers in one pass: each line is split off once and all its hits are one array. Test files meet the heuristics only."""
    path, line = F.col("file_path"), F.col("line_text")
    chosen = rules.select_rules((*rules.CATALOG, *custom), severities)
    raw, language = F.col("raw_line"), F.col("language")
    # what a path says is said once a file, not once a line
    known = files.withColumns({"__tested": is_test_path(path), "__suffixed": suffix(path).isin(*heuristics.WEB, *heuristics.NATIVE)})
    tested, suffixed = F.col("__tested"), F.col("__suffixed")
    rows = explode_lines(known.where(~tested | suffixed)).where(suffixed | rules.any_match(chosen, raw, language) | heuristics.quotes_or_secret(line))
    checked = F.when(~tested, F.concat(rules.finding_hits(chosen, raw, language), heuristics.secret_hits(line))).otherwise(hits.none())
    return hits.explode_hits(rows, F.concat(checked, F.when(suffixed, heuristics.heuristic_hits(path, line)).otherwise(hits.none())))


def layers(files: DataFrame, severities: Sequence[str] | None = None, custom=(), deep: bool = True) -> DataFrame:
    """All layers, not yet unique. Severities choose line rules only, as the other layers don't look at them.

    Lines are one pass over the corpus; the two Python layers read their own languages' files only.
    """
    files = files.select("file_path", "language", "content")
    if not deep:
        return findings.union_layers(rules.line_findings(files, severities=severities, custom=custom))
    return findings.union_layers(line_layers(files, severities, custom), python_ast.python_findings(files), calls.call_findings(files))


def scan(files: DataFrame, severities: Sequence[str] | None = None, custom=(), deep: bool = True, config: dict | None = None, plugins: Plugins | None = None) -> DataFrame:
    """Unique findings of (file_path, language, content) files, after the configuration's exclusions, suppressions and severities. Rank them with :func:`findings.rank`.

    Findings of ``plugins`` are appended after the layers' (JOIN-12).
    """
    config = config or {}
    found = layers(files, severities, custom, deep)
    if plugins and plugins.names():
        found = found.unionByName(findings.union_layers(plugins.findings(files)))
    out = findings.dedup(found)
    out = findings.exclude_paths(out, config.get("excludedPaths") or ())
    out = findings.suppress(out, config.get("suppressions") or {})
    return findings.override_severity(out, config.get("severityOverrides") or {})


def editor_scan(files: DataFrame, custom=()) -> DataFrame:
    """The editor's contract: five languages, rules with their own case, lines and columns from 0, the last of equal places."""
    files = files.where(F.col("language").isin("javascript", "typescript", "python", "java", "php"))
    return rules.editor_view(findings.dedup_editor(rules.line_findings(files, custom=custom, editor=True)))


#: Plugin texts that this process has run already.
_loaded: dict[str, Plugin] = {}


class Plugins:
    """UDF-1, UDF-2: named plugins; one that fails on a file yields nothing there and leaves a row saying so."""

    SCHEMA = "plugin string, file_path string, rule_id string, severity string, line int, message string, error string"

    def __init__(self):
        self._held: dict[str, tuple[Plugin, tuple[str, ...]]] = {}

    def register(self, name: str, plugin: Plugin, languages: tuple[str, ...] = ("*",)) -> None:
        self._held[name] = (plugin, languages)

    def names(self) -> list[str]:
        return sorted(self._held)

    def for_language(self, language: str) -> list[str]:
        return sorted(n for n, (_, langs) in self._held.items() if "*" in langs or language in langs)

    def run(self, files: DataFrame) -> DataFrame:
        ship(files.sparkSession)
        held = dict(self._held)

        def work(batches):
            fields = [f.split()[0] for f in self.SCHEMA.split(", ")]
            kind = pa.schema([(f, pa.int32() if f == "line" else pa.string()) for f in fields])
            for b in batches:
                out = []
                for path, language, content in zip(*(b.column(c).to_pylist() for c in ("file_path", "language", "content")), strict=True):
                    for name, (plugin, langs) in held.items():
                        if "*" not in langs and language not in langs:
                            continue
                        try:
                            out += [{"plugin": name, "file_path": path, **{k: x.get(k) for k in ("rule_id", "severity", "line", "message")}} for x in plugin(path, content)]
                        except Exception as e:
                            out.append({"plugin": name, "file_path": path, "error": str(e)})
                yield pa.RecordBatch.from_pylist(out, kind)

        return files.select("file_path", "language", "content").mapInArrow(work, self.SCHEMA)

    def findings(self, files: DataFrame) -> DataFrame:
        """The plugins' findings in the finding schema; what a plugin leaves out gets a default, and failures are left to :meth:`run`."""
        rows = self.run(files).where("error is null")
        return rows.select(
            "file_path", F.coalesce("line", F.lit(1)).alias("line"), F.lit("").alias("line_text"), F.coalesce("rule_id", F.lit("unknown")).alias("rule_id"), F.coalesce("severity", F.lit("medium")).alias("severity"), F.lit(1).alias("column"), F.lit(1).alias("length"),
            F.coalesce("message", F.lit("")).alias("message"), F.lit("").alias("explanation"), F.lit("").alias("fix"), F.lit("medium").alias("confidence"), F.concat(F.lit("plugin:"), "plugin").alias("analyzer"), F.lit(5).alias("layer_ord"), F.lit(0).alias("rule_ord"),
        )

    def load(self, path: str) -> None:
        """Register the function ``analyze(path, text)`` of a Python file, under the file's name; it may say its ``LANGUAGES``. The code travels with the task."""
        with open(path, encoding="utf-8") as f:
            text = f.read()
        name = os.path.splitext(os.path.basename(path))[0]
        spaces: dict = {"__name__": f"plugin_{name}"}
        exec(compile(text, path, "exec"), spaces)
        if not callable(spaces.get("analyze")):
            raise ValueError(f"{path} has no function analyze(path, text)")

        def run(file_path: str, content: str, text=text, path=path):
            held = _loaded.get(text)
            if held is None:
                made: dict = {"__name__": "plugin"}
                exec(compile(text, path, "exec"), made)
                held = _loaded[text] = made["analyze"]
            return held(file_path, content)

        self.register(name, run, tuple(spaces.get("LANGUAGES", ("*",))))


# The classes that a model is asked about.
ASKED = ("SQL Injection", "Command Injection", "Cross-Site Scripting", "Hardcoded Secret", "Path Traversal", "Insecure Deserialization", "Weak Cryptography", "SSRF", "Open Redirect")


def prompts(files: DataFrame, cut: int = 3000) -> DataFrame:
    """AI-2, AI-4: (file_path, lines, prompt): what a model is asked about each file, its text cut to ``cut`` characters."""
    ask = f"Find security vulnerabilities ({', '.join(ASKED)}). Answer with a JSON array of objects with type, severity, line, message, explanation, fix and cwe.\n"
    return files.select("file_path", F.size(F.split("content", "\n", -1)).alias("lines"), F.concat(F.lit(ask), F.lit("Language: "), F.coalesce("language", F.lit("")), F.lit("\n"), F.substring("content", 1, cut)).alias("prompt"))


def with_models(prompts: DataFrame, ask: Callable[[str], str], cut: int = 3000) -> DataFrame:
    """AI-1..3: (prompt) rows answered by a pluggable function, each distinct text once (in place of a cache); texts are cut to ``cut`` characters. Off unless called."""

    def work(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([ask(x or "") for x in b.column("text").to_pylist()], pa.string())], ["key", "answer"])

    ship(prompts.sparkSession)
    rows = prompts.withColumn("key", F.sha2(F.substring("prompt", 1, cut), 256))
    answers = rows.select("key", F.substring("prompt", 1, cut).alias("text")).dropDuplicates(["key"]).mapInArrow(work, "key string, answer string")
    return rows.join(answers, "key").drop("key")


def describe(name: str = TOOL) -> str:
    return f"{name}: {len(rules.CATALOG)} line rules, {sum(map(len, calls.RULES.values()))} call rules"
