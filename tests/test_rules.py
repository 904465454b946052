import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sastra.functions.text import entropy, explode_lines, is_syntax_test_path, is_test_path, language_of
from sastra.operators import findings, python_ast, rules
from sastra.plans import scan
from sastra.plans.snippets import LINES, PYTHON

# sample number: rule number, column, length (rules count from 1)
EXPECTED = {
    0: [(1, 15, 20)], 1: [(2, 4, 14)], 2: [(3, 6, 22)], 3: [(4, 4, 12)], 4: [(5, 4, 17)], 5: [(6, 1, 23)], 6: [(7, 5, 12), (8, 13, 4)], 7: [(8, 21, 3)],
    8: [(9, 9, 13)], 9: [(10, 6, 11)], 10: [(11, 1, 13)], 11: [(12, 7, 10)], 12: [(13, 4, 34)], 13: [(14, 1, 18)], 14: [(15, 5, 18)], 15: [(16, 11, 17)],
    16: [(4, 4, 23), (17, 4, 33)], 17: [(18, 1, 21)], 18: [(19, 1, 36)], 19: [(20, 6, 8)], 20: [(21, 1, 18)], 21: [], 22: [(22, 6, 13)], 23: [(23, 1, 8)],
    24: [(24, 1, 19)], 25: [(25, 9, 12)], 26: [(8, 9, 4), (26, 9, 6)], 27: [(27, 1, 7)], 28: [(28, 10, 9)], 29: [(29, 3, 11)], 30: [(30, 7, 15)], 31: [],
    32: [(31, 1, 29)], 33: [(32, 1, 16)], 34: [(33, 6, 13)], 35: [(34, 1, 13)], 36: [(35, 5, 15)], 37: [(36, 1, 12)], 38: [], 39: [], 40: [], 41: [], 42: [], 43: [],
}


def files(spark, rows):
    return spark.createDataFrame([(f"app/s{i}.x", language, line) for i, (language, line) in enumerate(rows)], "file_path string, language string, content string")


def test_catalog_size():
    assert len(rules.CATALOG) == 36


def test_samples(spark):
    got = {}
    for r in rules.line_findings(files(spark, LINES[:44])).collect():
        got.setdefault(int(r["file_path"][5:-2]), []).append((r["rule_ord"] + 1, r["column"], r["length"]))
    assert {i: sorted(got.get(i, [])) for i in EXPECTED} == EXPECTED


def test_same_as_python_regex(spark):
    lines = [line for _, line in LINES] + ["", "é DES é", "a b exec(x +", "SELECT"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    every = tuple(rules.Rule(r.type, r.severity, r.regex, ("*",), r.cwe) for r in rules.CATALOG)
    for r in rows.select("i", rules.hits(every, F.col("line"), F.lit("x")).alias("h")).collect():
        want = []
        for k, rule in enumerate(rules.CATALOG):
            m = re.search(rule.regex, lines[r["i"]], re.I | re.M)
            if m:
                want.append((k, m.start() + 1, m.end() - m.start()))
        assert [tuple(x) for x in r["h"]] == want


def test_anchors_keep_every_match():
    for _, line in LINES:
        if any(re.search(r.regex, line, re.I) for r in rules.CATALOG):
            assert re.search(rules.ANCHORS.replace("(?i)", ""), line, re.I), line


def test_all_matches(spark):
    df = spark.createDataFrame([("a12b345c",), ("",), ("none",)], "t string")
    got = [[tuple(m) for m in r[0]] for r in df.select(rules.all_matches(F.col("t"), "[0-9]+")).collect()]
    assert got == [[(2, 2), (5, 3)], [], []]


def test_lines(spark):
    df = spark.createDataFrame([("a", "x\r\ny\n"), ("b", ""), ("c", None), ("d", "one")], "file_path string, content string")
    got = [(r["file_path"], r["line"], r["line_text"], r["raw_line"]) for r in explode_lines(df).orderBy("file_path", "line").collect()]
    assert got == [("a", 1, "x", "x\n"), ("a", 2, "y", "y\n"), ("d", 1, "one", "one")]
    assert explode_lines(df, keep_last_empty=True).count() == 6


@pytest.mark.parametrize(("path", "language", "test", "tree"), [("a/b.py", "python", False, False), ("a/.py", "", False, False), ("A.JSX", "javascript", False, False), ("a/tests/x.go", "go", True, True), ("a/latest_x.py", "python", False, True), ("x\\test_y.rs", "rust", True, True), ("noext", "", False, False)])
def test_paths(spark, path, language, test, tree):
    r = spark.range(1).select(language_of(F.lit(path)), is_test_path(F.lit(path)), is_syntax_test_path(F.lit(path))).first()
    assert tuple(r) == (language, test, tree)


def test_entropy(spark):
    assert abs(spark.range(1).select(entropy(F.lit("sk-1234567890abcdef"))).first()[0] - 4.2479) < 1e-3


def test_python_tree(spark):
    df = spark.createDataFrame(list(PYTHON), "file_path string, content string")
    got = sorted((r["file_path"], r["rule_id"], r["line"], r["column"], r["confidence"]) for r in python_ast.python_findings(df).collect())
    assert got == [
        ("app/a.py", "Command Injection (AST)", 4, 0, "high"), ("app/a.py", "Hardcoded Secret (AST)", 2, 0, "high"), ("app/a.py", "Insecure Deserialization (AST)", 5, 4, "high"),
        ("app/a.py", "Path Traversal (AST)", 6, 4, "high"), ("app/a.py", "Path Traversal (AST)", 6, 4, "high"), ("app/a.py", "SQL Injection (AST)", 3, 0, "high"),
        ("app/d.py", "Cross-Site Scripting (AST)", 1, 0, "medium"), ("app/d.py", "Path Traversal (AST)", 2, 0, "high"),
    ]


def test_calls(spark):
    from sastra.operators import calls

    rows = [("python", "cur.execute(request.args)"), ("python", "cur.execute(sql)"), ("php", "evaluate($_GET[1]);"), ("php", "eval($x);"), ("java", "new ProcessBuilder(request.getParameter(1)).exec()"), ("go", "db.Query(fmt.Sprintf(q, x))"), ("ruby", "User.where(params[:u])"), ("rust", "fn unsafe_fn(x)"), ("kotlin", "view.loadUrl(intent.getData())"), ("cobol", "exec(req)")]
    got = {}
    for r in findings.dedup(calls.call_findings(files(spark, rows))).collect():
        got.setdefault(int(r["file_path"][5:-2]), set()).add(r["rule_id"].removesuffix(" (call)"))
    assert got == {0: {"Python: Sql Injection"}, 3: {"PHP: Dynamic Code Execution"}, 4: {"Java: Command"}, 5: {"Go: SQL Injection"}, 6: {"Ruby: SQL Injection"}, 8: {"Kotlin: WebView XSS"}}


def test_every_call_rule_fires(spark):
    from sastra.operators import calls
    from sastra.plans.snippets import CALLS

    names = {r.rule.removesuffix(" (call)") for rows in calls.RULES.values() for r in rows} | {"Rust: Unsafe Block", "Python: Hardcoded Secret"}
    assert {rule for _, _, raised in CALLS for rule, *_ in raised} == names
    for language, text, raised in CALLS:
        assert [(r["rule_id"].removesuffix(" (call)"), r["severity"], r["cwe"], r["line"]) for r in calls.found_in(text, language)] == [tuple(x) for x in raised], text


@given(st.text(alphabet="ab.(){}[]'\"`;,=\n#/*$ \\", max_size=60), st.sampled_from(["python", "javascript", "go", "rust", "java", "php", "ruby", "csharp", "typescript", "kotlin"]))
def test_call_scan_takes_any_text(text, language):
    from sastra.operators import calls, syntax

    calls.found_in(text, language)
    for c in syntax.scan(text, language).calls:
        assert 0 <= c.start <= c.own.end <= len(text) and c.above.start <= c.above.end


def test_call_scan_is_linear():
    import time

    from sastra.operators import calls

    for text in ("f(" * 100_000, "f(x)" * 50_000, "x = [" + "run(a),\n" * 60_000 + "]", ")" * 200_000, "a.b" * 100_000):
        began = time.perf_counter()
        calls.found_in(text, "python")
        assert time.perf_counter() - began < 20


def test_line_layers_are_their_union(spark):
    rows = spark.createDataFrame([(f"a/s{i}.{e}", language, line) for i, (language, line) in enumerate(LINES) for e in ("js", "go", "rs", "py")] + [("x/test_a.js", "javascript", "const q = x.innerHTML; eval(input)"), ("e.py", "python", None)], "file_path string, language string, content string")
    names = ["file_path", "line", "rule_id", "severity", "column", "length", "message", "cwe", "confidence", "analyzer", "layer_ord"]
    from sastra.operators import heuristics

    apart = [rules.line_findings(rows), heuristics.heuristic_findings(rows), heuristics.secret_findings(rows)]
    want = sorted((tuple(r) for part in apart for r in part.select(*names).collect()), key=repr)
    assert sorted((tuple(r) for r in scan.line_layers(rows).select(*names).collect()), key=repr) == want and len(want) > 40


def test_catalog_says_what_to_do():
    assert all(r.message and r.explanation and r.fix and "Good: " in r.example for r in rules.CATALOG)


def test_scan_is_unique_and_idempotent(spark):
    rows = spark.createDataFrame([("a.py", "python", 'token = "abcdefghij"; token = "abcdefghij"\n' * 2)], "file_path string, language string, content string")
    found = scan.scan(rows)
    assert found.count() == found.select(*findings.KEY).distinct().count() == findings.dedup(found).count()
    assert {r["rule_id"] for r in found.collect()} >= {"Hardcoded Secret", "Hardcoded Secret (AST)"}


def test_severities_choose_line_rules_only(spark):
    rows = spark.createDataFrame([("a.js", "javascript", "let r = Math.random(); x.innerHTML = 1")], "file_path string, language string, content string")
    assert {r["rule_id"] for r in rules.line_findings(rows, severities=["high"]).collect()} == {"Cross-Site Scripting (XSS)"}


def test_empty_corpus(spark):
    empty = spark.createDataFrame([], "file_path string, language string, content string")
    assert scan.scan(empty).count() == 0 and scan.editor_scan(empty).count() == 0


@given(st.text(max_size=40))
def test_functions_scan_never_fails(text):
    from sastra.operators.graph import functions_of

    functions_of(text)
    python_ast.analyse(text)


def test_plugins(spark):
    rows = spark.createDataFrame([("a.py", "python", "x"), ("b.go", "go", "y")], "file_path string, language string, content string")
    held = scan.Plugins()
    held.register("all", lambda path, text: [{"rule_id": "p", "line": 1, "message": text}])
    held.register("bad", lambda path, text: 1 / 0, ("go",))
    got = sorted((r["plugin"], r["file_path"], r["error"] is not None) for r in held.run(rows).collect())
    assert got == [("all", "a.py", False), ("all", "b.go", False), ("bad", "b.go", True)]
    assert held.for_language("python") == ["all"]
    found = scan.scan(rows, plugins=held).collect()
    assert sorted((r["file_path"], r["rule_id"], r["severity"], r["analyzer"]) for r in found) == [("a.py", "p", "medium", "plugin:all"), ("b.go", "p", "medium", "plugin:all")]


def test_lines_are_gated_by_texts_that_matches_need(spark):
    # the cheap searches leave out nothing that a rule matches, whatever its case, and do leave out other lines
    custom = ("(?i)ab|c", r"[a-z&&[^b]]x", r"\Q+\E1", "x{0,2}yy@", "(ab|cd)+[.]e", "[:=]", r"a\.b|\$")
    chosen = [*rules.CATALOG, *(rules.Rule(f"c{i}", "low", r, ("*",), None) for i, r in enumerate(custom))]
    bad = [line for _, line in LINES]
    lines = [*bad, *map(str.upper, bad), *map(str.lower, bad), "ab", "C", "ax", "+1", "XXYY@", "CD.E", "plain words", "it's: so", "a=b", "$", "dES RC4", "described"]
    for language in ("go", "python", "cpp", "ruby", "none"):
        rows = spark.createDataFrame([(x, language) for x in lines], "line string, language string")
        line, of = F.col("line"), F.col("language")
        plain = F.lit(False)
        for r in chosen:
            plain = plain | (rules.applies(r, of) & line.rlike(rules.dialect(r.regex)))
        got = rows.select(plain.alias("plain"), rules.any_match(chosen, line, of).alias("any"), (F.size(rules.hits(chosen, line, of)) > 0).alias("hits")).collect()
        assert all(r["plain"] == r["any"] == r["hits"] for r in got) and {r["plain"] for r in got} == {True, False}
    words = spark.createDataFrame([("described at length",), ("a token: here",), ("DES",)], "line string")
    crypto, secret = (rules.CATALOG[i].regex for i in (7, 5))
    got = words.select(rules.may_match(F.col("line"), crypto), rules.may_match(F.col("line"), secret)).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, False), (True, False)]
