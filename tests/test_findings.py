import itertools
import json

import pytest
from pyspark.sql import functions as F

from sastra import cli
from sastra.operators import exploitability, findings, graph, knowledge, sessions
from sastra.plans import scan
from sastra.plans.snippets import APP
from sastra.sinks import reports
from sastra.sources import corpus
from sastra.streaming import events

SCHEMA = "rule_id string, severity string, file_path string, line int, column int, length int, message string, explanation string, fix string, cwe string, confidence string, source string, sink string, dataflow_path string, analyzer string, layer_ord int, rule_ord int, line_text string"


def found(spark, *rows):
    base = {"severity": "high", "file_path": "a.py", "line": 1, "column": 1, "length": 3, "message": "m", "explanation": "", "fix": "f", "cwe": "CWE-89", "confidence": "high", "analyzer": "regex", "layer_ord": 0, "rule_ord": 0, "line_text": "x"}
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(({"rule_id": "R"} | base | r).get(n) for n in names) for r in rows], SCHEMA)


def test_dedup_keeps_the_first_layer(spark):
    df = found(spark, {"layer_ord": 2, "message": "late"}, {"layer_ord": 0, "column": 9, "message": "b"}, {"layer_ord": 0, "column": 2, "message": "a"})
    assert [r["message"] for r in findings.dedup(df).collect()] == ["a"]
    assert findings.dedup_editor(df).count() == 3


def test_drift_parts(spark):
    before, now = found(spark, {"line": 1}, {"line": 2}), found(spark, {"line": 2}, {"line": 3})
    lines = lambda df: sorted(r["line"] for r in df.collect())
    assert lines(findings.drift_new(now, before)) == [3]
    assert lines(findings.drift_resolved(now, before)) == [1]
    assert lines(findings.drift_new(now, before).union(findings.drift_persisting(now, before))) == lines(now)
    assert lines(findings.regressions(now, before, found(spark, {"line": 3}))) == [3]


def test_equal_histories_get_equal_scores(spark):
    # the score is 2 but for rounding, so it would fall on either side with the order of additions
    orders = list(itertools.permutations((7, 6, 10, 14, 10)))
    history = spark.createDataFrame([(i, n) for i, counts in enumerate(orders) for n in counts], "repo int, n long").coalesce(1)
    rows = findings.anomalies(history, spark.createDataFrame([(i, 15) for i in range(len(orders))], "repo int, n long"), least=2.0).collect()
    assert len(rows) == 120 and len({r["anomalous"] for r in rows}) == 1 and {r["mean"] for r in rows} == {9.4} and {round(r["score"], 9) for r in rows} == {2.0}


def test_a_report_runs_its_scan_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = found(spark, *({"line": i, "severity": ("high", "low")[i % 2]} for i in range(40)))
    assert reports.report_lines("text", rows.mapInArrow(look, rows.schema)).count() == 41 and seen.value == 40
    assert reports.remediation_plan(rows.mapInArrow(look, rows.schema)).count() == 40 and seen.value == 80


def test_gates(spark):
    df = found(spark, {"severity": "info"}, {"severity": "low", "line": 2})
    assert findings.fails(df, "low") and not findings.fails(df, "medium")
    assert findings.gate("prod") == ("critical",) and findings.gate("prod", ["low"]) == ["low"] and findings.gate("x") is None


@pytest.mark.parametrize(("rule", "cwe", "strict", "name"), [("Hardcoded Secret", "CWE-798", False, "xss"), ("Hardcoded Secret", "CWE-798", True, "hardcoded_secret"), ("Command Injection", None, False, "sql_injection"), ("x", None, False, "general")])
def test_classes(spark, rule, cwe, strict, name):
    row = exploitability.score(found(spark, {"rule_id": rule, "cwe": cwe}), strict=strict).first()
    assert row["exploit_class"] == name


def test_score(spark):
    row = exploitability.score(found(spark, {"rule_id": "Path Traversal", "cwe": "CWE-22", "severity": "low", "confidence": "low", "line_text": "open(admin_file)"})).first()
    raw = 4.0 * 0.7 * 0.7 * 0.8 * 0.3 * (1 - 0.3 * 0.4) * (1 + 0.8 * 0.3) * 1.5
    assert row["exploitability_score"] == round(raw, 1) and row["exploitability_label"] == "Low"
    empty = exploitability.summary(exploitability.score(found(spark, {}).limit(0))).first()
    assert tuple(empty) == (0.0, 0.0, 0, 0)


def test_feedback_and_plan(spark):
    df = found(spark, {"severity": "critical", "cwe": "CWE-798"}, {"severity": "low", "line": 2, "cwe": None}, {"severity": "critical", "confidence": "low", "rule_id": "A"})
    got = {r["line"]: (r["priority_score"], r["attack_vector"]) for r in knowledge.feedback(df).collect()}
    assert got[2] == (24, "local")
    plan = [r["text"] for r in reports.remediation_plan(df).orderBy("n").collect()]
    assert plan[0].startswith("CRITICAL PRIORITY\n1. R") and plan[1].startswith("2. A") and plan[2].startswith("LOW PRIORITY\n3. R")


def test_reports(spark):
    df = found(spark, {"message": "<b>&", "severity": "critical"}, {"line": 2, "cwe": None})
    j = json.loads(reports.report_text("json", df, "p", "t"))
    assert j["total"] == 2 and j["findings"][0]["severity"] == "critical" and j["findings"][0]["source"] is None and j["timestamp"] == "t"
    s = json.loads(reports.report_text("sarif", df))
    assert s["version"] == "2.1.0" and s["runs"][0]["results"][0]["level"] == "error" and len(s["runs"][0]["results"]) == 2
    assert "CRITICAL (1)" in reports.report_text("text", df, "p") and "No security issues" in reports.report_text("text", df.limit(0), "p")
    assert json.loads(reports.report_text("json", df.limit(0), "p", "t"))["findings"] == []
    page = reports.report_text("html", df, "p", "t")
    assert "&lt;b&gt;&amp;" in page and "<b>&" not in page and page.count("<h2>") == 2
    assert "definitions/89.html" in reports.report_text("markdown", df, "p", "t")
    assert 'tests="2" failures="2"' in reports.junit_report(df)
    assert [f["text"] for f in reports.slack_payload(df)["blocks"][1]["fields"]][0] == "*Critical:* 1"
    assert reports.annotations(df, "error").count() == 1
    assert "CRITICAL SEVERITY:\n  1. R (Line 1)" in reports.editor_report(df) and "No security" in reports.editor_report(df.limit(0))
    assert "&lt;b&gt;" in reports.learn_more(df).orderBy("html").first()[0] and reports.commit_verdict(df) == 1
    assert "Critical (>=80): 0" in reports.feedback_report(knowledge.feedback(df), "t") and "  network: 1 findings" in reports.feedback_report(knowledge.feedback(df), "t")


def test_report_parts(spark, tmp_path):
    df = found(spark, *({"line": i, "severity": s} for i in range(40) for s in ("critical", "low", "odd")))
    reports.write_report("json", df, str(tmp_path / "r"), "p", "t")
    parts = sorted((tmp_path / "r").glob("part-*"))
    made = json.loads("".join(p.read_text() for p in parts))
    assert [(x["severity"], x["line"]) for x in made["findings"]] == [(s, i) for s in ("critical", "low", "odd") for i in range(40)]
    rows = findings.grouped(df).collect()
    assert {r["n"] for r in rows} == {40} and sorted((r["severity"], r["nth"], r["line"]) for r in rows) == [(s, i + 1, i) for s in ("critical", "low", "odd") for i in range(40)]


def test_texts_for_people(spark):
    row = found(spark, {"rule_id": "Hardcoded Secret", "explanation": "why", "line_text": "a b c", "column": 3, "length": 1})
    text = row.select(reports.detail_text(row)).first()[0]
    assert text.split("\n")[0] == "WHY: why" and "EXAMPLE: token = os.environ" in text and "REFERENCE: CWE-89 https" in text
    fixes = {r["title"]: r["new_line"] for r in reports.quick_fix(row).collect()}
    assert fixes == {"Fix: Hardcoded Secret": 'a token = os.environ["APP_TOKEN"] c', "Accept: Hardcoded Secret": "a b c  # sastra-ignore: Hardcoded Secret"}
    pages = {r["id"]: r["html"] for r in knowledge.module_pages(knowledge.training_modules(spark)).collect()}
    assert len(pages) == 3 and pages["secrets-management"].count("<button") == 3 and "Hardcoded" not in pages["xss-prevention"]
    assert [r["correct"] for r in knowledge.check_quiz(spark.createDataFrame([("xss-prevention", 1), ("none", 0)], "id string, selected int")).orderBy("id").collect()] == [None, True]
    assert reports.chat_rows(spark.createDataFrame([("i", "x", None)], "instruction string, input string, output string")).first()[0] == "<|im_start|>user\ni\n\nCode:\nx<|im_end|>\n<|im_start|>assistant\n<|im_end|>"


def test_conditional_reachability(spark):
    files = spark.createDataFrame([("a.py", "def takes():\n    return input()\n"), ("b.py", "def ends():\n    eval(1)\n"), ("c.py", "TAKES(1) + xendsx"), ("d.py", "ta kes ends"), ("e.py", None)], "file_path string, content string")
    funcs = graph.functions(files)
    rows = spark.createDataFrame([(f"{x}.py",) for x in "abcde"], "file_path string")
    got = {r["file_path"]: r["reachability"]["status"] for r in graph.verdicts(rows, files, funcs, graph.call_edges(funcs)).collect()}
    assert got == {"a.py": "UNREACHABLE", "b.py": "UNREACHABLE", "c.py": "CONDITIONALLY_REACHABLE", "d.py": "UNREACHABLE", "e.py": "UNREACHABLE"}


def test_functions_end_where_indentation_does():
    code = "x = 1\ndef a(p):\n\n  one\n# note\n  two\nthree\nclass C:\n  async def b(self):\n    four\n    def c():\n      five\n    six\nconst d = (x) => {\n  seven\n}\ndef a():\n  last"
    assert graph.functions_of(code) == [("a", "def a():\n  last"), ("b", "  async def b(self):\n    four"), ("c", "    def c():\n      five"), ("d", "const d = (x) => {\n  seven")] or dict(graph.functions_of(code))["c"] == "    def c():\n      five"
    assert graph.functions_of(None) == []


def test_watching_replaces_findings(spark, tmp_path):
    schema = "file_path string, ts int, language string, content string"
    secret = 'token = "abcdefghij"'
    (tmp_path / "rules.json").write_text(json.dumps({"customPatterns": [{"type": "Old", "regex": "zzz"}]}))
    for n, rows in enumerate(([("a.py", 1, "python", secret), ("b.py", 1, "python", f"{secret} # zzz")], [("a.py", 2, "python", "x = 1")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        events.watch(events.read_files(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "ck"), str(tmp_path / "rules.json"), deep=False).awaitTermination(60)
        (tmp_path / "rules.json").write_text(json.dumps({"customPatterns": [{"type": "New", "regex": "x = 1"}]}))
    now = events.current(spark, str(tmp_path / "out"), spark.read.parquet(str(tmp_path / "out/files"))).collect()
    assert sorted((r["file_path"], r["rule_id"]) for r in now) == [("a.py", "New"), ("b.py", "Hardcoded Secret"), ("b.py", "Old")]


def test_endpoints():
    from io import BytesIO

    from sastra import api

    model = lambda kind, data: {"kind": kind, **data}
    assert api.answer("GET", "/health", b"", None) == (200, {"status": "loading"}) and api.answer("GET", "/other", b"", model)[0] == 404
    assert api.answer("POST", "/analyze", b"{}", None)[0] == 503 and api.answer("POST", "/analyze", b'{"type": "odd"}', model)[0] == 400 and api.answer("POST", "/analyze", b"[", model)[0] == 400
    assert api.answer("POST", "/analyze", b'{"type": "cve", "data": {"cve_id": "C", "x": 1}}', model) == (200, {"kind": "cve", "cve_id": "C"})
    said = []
    body = b'{"content": "hi"}'
    out = api.application(model)({"REQUEST_METHOD": "POST", "PATH_INFO": "/detect-phishing", "CONTENT_LENGTH": str(len(body)), "wsgi.input": BytesIO(body)}, lambda s, h: said.append(s))
    assert said == ["200 OK"] and json.loads(b"".join(out)) == {"kind": "phishing", "content": "hi"}


def test_anomalies_and_exposure(spark):
    history = spark.createDataFrame([("a", 10), ("a", 12), ("b", 5), ("b", 5)], "repo string, n long")
    got = {r["repo"]: (r["score"], r["anomalous"]) for r in findings.anomalies(history, spark.createDataFrame([("a", 20), ("b", 6), ("c", 9)], "repo string, n long")).collect()}
    assert got == {"a": (9.0, True), "b": (None, True), "c": (None, False)}
    weights = [r[0] for r in spark.createDataFrame([("src/auth/api.py",), ("lib/x.py",), ("a/tests/api.py",)], "p string").select(findings.surface_weight(F.col("p"))).collect()]
    assert weights == [1.5, 1.0, 0.3]
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "a")], "src string, dst string")
    assert sorted(tuple(r) for r in graph.distances(edges, spark.createDataFrame([("a",), ("z",)], "id string")).collect()) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 1), ("z", "z", 0)]


def test_edits(spark):
    r = spark.range(1).select(
        reports.apply_fix(F.lit("a = md5(x)"), F.lit(5), F.lit(3), F.lit("sha256")), reports.good_example(F.lit("Bad: a\nGood: b")), reports.ignore_comment(F.lit("python"), F.lit("R")),
        reports.salvage(F.lit('x {"a": 1} y'), "a int"), reports.salvage(F.lit("none"), "a int"),
    ).first()
    assert r[0] == "a = sha256(x)" and r[1] == "b" and r[2] == "# sastra-ignore: R" and r[3]["a"] == 1 and r[4] is None


def test_reachability(spark):
    files = spark.createDataFrame(list(APP), "file_path string, content string")
    funcs = graph.functions(files)
    paths = graph.shortest_paths(graph.call_edges(funcs), graph.sources(funcs), graph.sinks(funcs)).collect()
    assert [(r["path"], r["length"]) for r in paths] == [(["handle", "fetch_user"], 2)]
    assert graph.call_edges(funcs, strict=True).where("src = dst").count() == 0
    lone = files.where("file_path = 'app/cli.py'")
    f = graph.functions(lone)
    got = graph.verdicts(spark.createDataFrame([("app/cli.py",)], "file_path string"), lone, f, graph.call_edges(f)).first()["reachability"]
    assert got["status"] == "UNREACHABLE" and got["reason"] == "no_sources_or_sinks_found"


def test_own_source_and_sink(spark):
    files = spark.createDataFrame([("a.py", "def f():\n    eval(input())\n")], "file_path string, content string")
    funcs = graph.functions(files)
    paths = graph.shortest_paths(graph.call_edges(funcs), graph.sources(funcs), graph.sinks(funcs)).collect()
    assert [r["path"] for r in paths] == [["f", "f"]]


@pytest.mark.parametrize(("row", "name"), [((0, [], 0), "scanner"), ((5, [], 11), "brute_forcer"), ((31, ["WGET x"], 0), "ransomware_dropper"), ((31, ["ls"], 0), "interactive_attacker"), ((5, ["ls"], 0), "script_based_attacker"), ((5, [], 0), "scanner")])
def test_attackers(spark, row, name):
    df = spark.createDataFrame([("ip", row[0], row[1], [], [(None,)] * row[2])], sessions.SESSION)
    assert sessions.attacker_class(df).first()["attacker_class"] == name


def test_triage(spark):
    rows = [("ip", 0, [], [], [])] * 100 + [("ip", 9, ["a", "b", "c"], [], [])]
    assert sessions.triage(spark.createDataFrame(rows, sessions.SESSION)).where("verdict = 'threat'").count() == 1


def test_systemic(spark):
    rows = [("r1", "a", 'q = "SELECT" + x'), ("r2", "b", 'q = "select" + x '), ("r1", "c", "other")]
    got = findings.systemic(spark.createDataFrame(rows, "repo string, file_path string, line_text string")).collect()
    assert [(r["repos"], r["files"]) for r in got] == [(2, 2)]


def test_directory_and_command_line(spark, tmp_path, capsys):
    root = tmp_path / "src"
    for name, text in {"a.py": 'token = "abcdefghij"\n', "b.md": "x", "node_modules/c.js": "x.innerHTML = 1", ".h/d.js": "x.innerHTML = 1", "e/f.rs": "unsafe { }"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    assert sorted(r["file_path"].rsplit("/", 1)[1] for r in corpus.scan_directory(spark, str(root)).collect()) == ["a.py", "f.rs"]
    (tmp_path / "rules.json").write_text(json.dumps({"customPatterns": [{"type": "Tok", "regex": "tok", "severity": "low"}, {"regex": "("}]}))
    args = cli.parser().parse_args(["scan", str(root), "--format", "json", "--fail-on", "high", "--custom-rules", str(tmp_path / "rules.json"), "--drift", str(tmp_path / "state"), "--exploitability"])
    assert cli.run_scan(spark, args) == 1
    first = capsys.readouterr().out
    assert "first scan" in first and '"Tok"' in first
    assert cli.run_scan(spark, args) == 1
    assert "new 0, resolved 0" in capsys.readouterr().out
    (tmp_path / "plug.py").write_text("LANGUAGES = ('python',)\ndef analyze(path, text):\n    return [{'rule_id': 'Plugged', 'severity': 'low', 'line': 1, 'message': 'm'}]\n")
    args = cli.parser().parse_args(["scan", str(root), "--format", "json", "--quiet", "--plugin", str(tmp_path / "plug.py"), "--output", str(tmp_path / "one.json"), "--parts", str(tmp_path / "parts")])
    assert cli.run_scan(spark, args) == 0
    one = json.loads((tmp_path / "one.json").read_text())
    assert [x["rule_id"] for x in one["findings"]].count("Plugged") == 1
    assert json.loads("".join(p.read_text() for p in sorted((tmp_path / "parts").glob("part-*"))))["total"] == one["total"]
    assert corpus.load_rules(spark, str(tmp_path / "none.json")) == () and corpus.load_config(spark, str(tmp_path / "none.json")) is None


def test_config(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"excludedPaths": ["gen/"], "severityOverrides": {"Hardcoded Secret": "low"}, "suppressions": {"Hardcoded Secret (AST)": ["a.py"]}}))
    config = corpus.load_config(spark, str(tmp_path / "c.json"))
    rows = spark.createDataFrame([("a.py", "python", 'token = "abcdefghij"'), ("gen/b.py", "python", 'token = "abcdefghij"')], "file_path string, language string, content string")
    got = {(r["rule_id"], r["severity"]) for r in scan.scan(rows, config=config).collect()}
    assert ("Hardcoded Secret", "low") in got and not any("(AST)" in r for r, _ in got)


def test_stream(spark, tmp_path):
    rows = [("a.py", 1, "python", "x = 1"), ("a.py", 2, "python", 'token = "abcdefghij"')]
    spark.createDataFrame(rows, "file_path string, ts int, language string, content string").write.parquet(str(tmp_path / "in"))
    stream = events.read_files(spark, str(tmp_path / "in"), "file_path string, ts int, language string, content string")
    seen = []
    q = events.scan_changes(stream, lambda df: scan.scan(df, deep=False), lambda df, n: seen.extend(r["rule_id"] for r in df.collect()), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert seen == ["Hardcoded Secret"]


def test_models_ask_once(spark):
    df = spark.createDataFrame([("p",), ("p",), ("q",)], "prompt string")
    assert sorted(r["answer"] for r in scan.with_models(df, lambda x: x * 2).collect()) == ["pp", "pp", "qq"]


def test_model_round(spark):
    files = spark.createDataFrame([("a.py", "python", "x\ny")], "file_path string, language string, content string")
    asked = scan.prompts(files, 1)
    assert asked.first()["prompt"].endswith("python\nx")
    answers = scan.with_models(asked, lambda p: 'so: [{"type": "T", "severity": "odd", "line": 99}]').withColumnRenamed("answer", "raw")
    row = reports.model_findings(answers).first()
    assert (row["rule_id"], row["severity"], row["line"], row["length"]) == ("T", "medium", 1, 100)


def test_signals(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"active_attackers": 3}')
    rows = knowledge.with_signals(found(spark, {}), corpus.load_signals(spark, str(tmp_path / "s.json"))).first()
    assert rows["attacker_aligned"] and not rows["breach_aligned"]
    assert [corpus.signals_status(spark, p) for p in (None, str(tmp_path / "none"), str(tmp_path / "s.json"))] == ["not_configured", "unreachable", "ok"]


def test_diagnostics(spark):
    row = reports.own_diagnostics(reports.diagnostics(found(spark, {"rule_id": "Weak X", "column": 2, "length": 9, "line_text": "abcd"}))).first()
    assert (row["line"], row["start"], row["end"], row["tag"]) == (0, 1, 4, "deprecated")


def test_paths_of_any_length(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(55)]
    edges = spark.createDataFrame([*chain, ("n20", "n3"), ("n55", "n7"), ("n40", "out"), ("n55", "end")], "src string, dst string")
    name = lambda x: spark.createDataFrame([(x,)], "name string")
    found = graph.shortest_paths(edges, name("n0"), name("n55")).collect()
    assert [(r["path"], r["length"]) for r in found] == [([f"n{i}" for i in range(56)], 56)]
    paths = graph.attack_paths(spark.createDataFrame([("n0",), ("n54",), ("end",)], "id string"), edges).collect()
    whole = [f"n{i}" for i in range(56)]
    want = [("n0", [*whole, "end"]), ("n0", [*whole[:41], "out"]), ("n54", ["n54", "n55", "end"]), ("n54", ["n54", "n55", *whole[7:41], "out"]), ("end", ["end"])]
    assert sorted((r["id"], r["path"]) for r in paths) == sorted(want)


def test_knowledge_graph(spark, tmp_path):
    nodes = spark.createDataFrame([("f", "a", 1), ("f", "b", 2), ("c", "x", 1)], "id string, type string, seq int")
    last = graph.upsert_nodes(nodes)
    assert {tuple(r) for r in last.collect()} == {("f", "b"), ("c", "x")}
    edges = graph.link(spark.createDataFrame([("f", "c"), ("f", "gone")], "src string, dst string"), "maps_to")
    kept = graph.valid_edges(edges, last)
    assert kept.count() == 1
    scores = {r["id"]: r["score"] for r in graph.graph_scores(last, kept).collect()}
    assert scores == {"f": 50, "c": 0}
    graph.export_graph(last, kept, str(tmp_path / "g"))
    assert spark.read.json(str(tmp_path / "g/edges")).count() == 1
