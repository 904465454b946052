"""The call layer: calls whose callee names a sink and whose own text, or that of the node above, names a source of user input.

Rules are data; :mod:`.syntax` finds the calls. Only path, language and content of files that hold a word of their language's rules travel to Python.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_test_path, normalise
from ..functions.workers import ship
from . import syntax


@dataclass(frozen=True)
class CallRule:
    rule: str
    severity: str
    cwe: str
    callees: tuple[str, ...]
    source: bool = True  # needs a token of user input in the call or the node above
    exact: bool = False  # the callee is one of the tokens, not just holds one
    also: str = ""  # the call's text must hold this

    def callees_low(self) -> tuple[str, ...]:
        return tuple(map(str.lower, self.callees))


def _rules(prefix: str, *rows) -> tuple[CallRule, ...]:
    return tuple(CallRule(f"{prefix}{name} (call)", *rest) for name, *rest in rows)


# Tokens of user input by language.
SOURCES = {
    "python": ("request", "input", "sys.argv", "environ", "args", "form", "params", "getenv", "body", "query", "data", "json", "cookies", "headers"),
    "javascript": ("req", "request", "params", "query", "body", "input", "process.env", "req.body", "req.query", "req.params", "event", "ctx", "arg"),
    "go": ("r.URL.Query()", "r.FormValue", "r.PostFormValue", "os.Args", "os.Getenv", "r.URL", "r.Body", "r.Header"),
    "rust": ("std::env::args", "std::io::stdin", "env::var", "std::env::var", "String::from_utf8_lossy"),
    "java": ("request.getParameter", "request.getQueryString", "request.getHeader", "request.getCookies", "HttpServletRequest", "@RequestParam", "@PathVariable", "@RequestBody", "@ModelAttribute"),
    "php": ("$_GET", "$_POST", "$_REQUEST", "$_SERVER", "$_COOKIE", "$_FILES", "php://input", "getenv", "getallheaders"),
    "ruby": ("params", "request", "env", "ARGV", "STDIN", "cookies", "session", "rack.input"),
    "csharp": ("Request.QueryString", "Request.Form", "Request.Params", "Request.Headers", "Request.Cookies", "HttpRequest", "HttpContext", "context.Request", "FromBody", "FromRoute", "FromQuery"),
    "typescript": ("req", "request", "params", "query", "body", "input", "process.env", "req.body", "req.query", "req.params", "ctx", "event", "arg", "req.headers"),
    "kotlin": ("request.getParameter", "request.getQueryString", "@RequestParam", "@PathVariable", "intent.getStringExtra", "intent.getData", "intent.getExtras", "activity.intent"),
}

# Sinks by language, in match order: rule, severity, weakness, callee tokens, source needed, exact, text needed.
RULES = {
    "python": _rules(
        "Python: ",
        ("Sql Injection", "critical", "CWE-89", ("execute", "executemany", "raw", "query", "cursor.execute", "db.execute", "db.session.execute", "session.execute")),
        ("Command Injection", "critical", "CWE-78", ("system", "popen", "run", "call", "Popen", "exec", "eval", "spawn", "check_output", "check_call", "getoutput")),
        ("Html Injection", "high", "CWE-79", ("innerHTML", "render_template", "Markup", "write")),
        ("File Injection", "high", "CWE-22", ("open", "read", "write", "save", "dump", "upload", "readfile")),
        ("Deserialize Injection", "critical", "CWE-502", ("loads", "load", "yaml.load", "pickle.load", "marshal.load")),
        ("Network Injection", "high", "CWE-918", ("get", "post", "request", "fetch", "urlopen", "urlretrieve")),
    ),
    "javascript": _rules(
        "",
        ("Cross-Site Scripting", "critical", "CWE-79", ("innerHTML", "document.write", "dangerouslySetInnerHTML", "outerHTML", "insertAdjacentHTML")),
        ("Command Injection", "critical", "CWE-78", ("exec", "spawn", "execSync", "execFile", "fork", "eval", "Function")),
        ("SQL/NoSQL Injection", "critical", "CWE-89", ("execute", "query", "raw", "find", "findOne", "aggregate", "$where")),
        ("SSRF", "high", "CWE-918", ("fetch", "axios", "get", "post", "request", "got")),
    ),
    "go": _rules(
        "Go: ",
        ("SQL Injection", "critical", "CWE-89", ("db.query", "db.exec", "db.queryrow"), False, False, "fmt.sprintf"),
        ("Command Injection", "critical", "CWE-78", ("exec.command", "exec.commandcontext")),
        ("SSRF", "high", "CWE-918", ("http.get", "http.post", "http.do")),
    ),
    "rust": _rules(
        "Rust: ",
        ("Command Injection", "critical", "CWE-78", ("command::new", "std::process::command")),
        ("Weak Crypto", "high", "CWE-327", ("md5", "sha1"), False),
    ),
    "java": _rules(
        "Java: ",
        ("Sql", "critical", "CWE-89", ("executeQuery", "executeUpdate", "prepareStatement", "Statement", "createQuery", "entityManager", "jdbcTemplate.query", "jdbcTemplate.update", "session.createQuery", "session.createSQLQuery")),
        ("Jndi", "critical", "CWE-917", ("InitialContext.lookup", "Context.lookup", "JndiTemplate.lookup")),
        ("Command", "critical", "CWE-78", ("Runtime.exec", "ProcessBuilder", "exec", "Runtime.getRuntime().exec")),
        ("Ssrf", "high", "CWE-918", ("URL.openConnection", "URL.openStream", "HttpURLConnection", "RestTemplate.exchange", "WebClient.create", "HttpClient.send", "okhttp3")),
        ("Deserialize", "critical", "CWE-502", ("ObjectInputStream.readObject", "readUnshared", "XMLDecoder.readObject")),
        ("Xss", "high", "CWE-79", ("response.getWriter().write", "PrintWriter.write", "out.write", "ModelAndView")),
    ),
    "php": _rules(
        "PHP: ",
        ("Dynamic Code Execution", "critical", "CWE-95", ("eval", "assert", "create_function"), False, True),
        ("SQL Injection", "critical", "CWE-89", ("mysqli_query", "mysql_query", "pg_query", "pdo.query", "pdo.exec"), False),
        ("Command Injection", "critical", "CWE-78", ("exec", "system", "shell_exec", "passthru")),
        ("LFI/RFI", "critical", "CWE-98", ("include", "require")),
    ),
    "ruby": _rules(
        "Ruby: ",
        ("Unsafe Deserialization", "critical", "CWE-502", ("yaml.load", "yaml.unsafe_load", "marshal.load", "marshal.restore"), False, True),
        ("Command Injection", "critical", "CWE-78", ("system",)),
        ("SQL Injection", "critical", "CWE-89", ("where", "find_by_sql", "execute")),
    ),
    "csharp": _rules(
        "C#: ",
        ("Sql", "critical", "CWE-89", ("SqlCommand", "OleDbCommand", "OdbcCommand", "EntityFramework", "context.Database.ExecuteSqlRaw", "FromSqlRaw", "ExecuteSqlRaw", "ExecuteSqlCommand", "SqlDataAdapter", "DbCommand")),
        ("Deserialize", "critical", "CWE-502", ("BinaryFormatter", "SoapFormatter", "NetDataContractSerializer", "LosFormatter", "JavaScriptSerializer", "XmlSerializer")),
        ("Command", "critical", "CWE-78", ("Process.Start", "ProcessStartInfo", "Diagnostics.Process.Start")),
        ("Ssrf", "high", "CWE-918", ("HttpClient.SendAsync", "HttpClient.GetAsync", "HttpClient.PostAsync", "WebClient.DownloadString", "WebRequest.Create")),
        ("Xss", "high", "CWE-79", ("Response.Write", "HttpContext.Current.Response.Write", "Html.Raw", "MvcHtmlString.Create")),
    ),
    "typescript": _rules(
        "TypeScript: ",
        ("Command Injection", "critical", "CWE-78", ("exec", "spawn", "execsync")),
        ("XSS", "critical", "CWE-79", ("innerhtml", "outerhtml", "document.write")),
        ("SQL Injection", "critical", "CWE-89", ("executequery", "queryraw", "fromsqlraw")),
        ("NoSQL Injection", "critical", "CWE-943", ("find", "findone", "aggregate", "$where")),
        ("SSRF", "high", "CWE-918", ("fetch", "axios.get", "axios.post", "got")),
    ),
    "kotlin": _rules(
        "Kotlin: ",
        ("WebView XSS", "critical", "CWE-79", ("loadurl", "loaddata")),
        ("SQL Injection", "critical", "CWE-89", ("rawquery", "execsql", "rawquerywithfactory")),
        ("Implicit Intent Hijack", "high", "CWE-927", ("startactivity", "startservice", "sendbroadcast")),
        ("Command Injection", "critical", "CWE-78", ("processbuilder",)),
    ),
}
#: Languages in which one call may raise several rules; in the others the first that fits counts.
SEVERAL = ("java", "csharp")
# Names that mark an assigned string of eight characters or more as a secret (Python).
SECRET_NAMES = ("password", "secret", "api_key", "apikey", "token", "access_key", "private_key", "auth", "credential", "passwd", "pwd", "key")
#: Languages whose callee is all that stands before the first bracket of the call's text.
CUT = ("go", "rust", "java", "ruby", "csharp", "kotlin")
_LOWER = {language: tuple(t.lower() for t in tokens) for language, tokens in SOURCES.items()}
_STRING = re.compile(r"""([A-Za-z]{0,2}(?:\"{3}(?:\\.|[^\\])*?\"{3}|'{3}(?:\\.|[^\\])*?'{3}|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'))\s*(?:\#.*)?""", re.S)


def _named_secret(statement: str) -> bool:
    """Does a Python statement set a name of :data:`SECRET_NAMES` to one string of eight characters or more?"""
    left, sign, right = statement.partition("=")
    name = left.split(":")[0].strip()
    if not sign or right[:1] == "=" or left[-1:] in tuple("!<>+-*/%&|^:@") or not name or len(name.split()) > 1 or not any(x in name.lower() for x in SECRET_NAMES):
        return False
    m = _STRING.fullmatch(right.strip())
    return bool(m) and len(m[1].strip("'\"")) >= 8


def _raised(language: str, callee: str, own: Callable[[], str], user: Callable[[], bool]) -> list[CallRule]:
    """The rules that a call of a lower-cased callee raises; ``own`` gives its lower-cased text, ``user`` whether user input is near."""
    out = []
    for r in RULES[language]:
        tokens = r.callees_low()
        if not (callee in tokens if r.exact else any(t in callee for t in tokens)) or r.also and r.also not in own()[:200]:
            continue
        if not r.source or user():
            out.append(r)
        if language not in SEVERAL:
            break
    return out


def found_in(code: str | None, language: str) -> list[dict]:
    """The call rules that one file raises, in order: rule, severity, cwe, line and column from 1, sink."""
    seen = syntax.scan(code or "", language)
    held: dict[int, bool] = {}

    def names_input(text: str) -> bool:
        low = text.lower()
        return any(t in low for t in _LOWER[language])

    def near(call: syntax.Call) -> bool:
        if id(call.above) not in held:  # many calls may stand in one bracket
            held[id(call.above)] = names_input(seen.text(call.above))
        return held[id(call.above)] or names_input(seen.text(call.own, call.start))

    out = []
    for c in seen.calls:
        callee = c.callee.lower()
        if language in CUT:
            callee = callee.split("(")[0]
        if language == "kotlin":
            callee = callee.split(".")[-1]
        sink = re.sub(r"\(.*\)", "()", c.callee, flags=re.S)
        out += [(c.start, r, sink) for r in _raised(language, callee, lambda c=c: seen.text(c.own, c.start).lower(), lambda c=c: near(c))]
    if language == "rust":
        out += [(at, CallRule("Rust: Unsafe Block (call)", "high", "CWE-119", ()), "unsafe") for at in seen.unsafe]
    if language == "python":
        secret = CallRule("Python: Hardcoded Secret (call)", "critical", "CWE-798", ())
        out += [(s.start, secret, None) for s in seen.statements if _named_secret(seen.text(s))]
    rows = []
    for at, r, sink in sorted(out, key=lambda x: x[0]):
        line, column = seen.place(at)
        rows.append({"rule_id": r.rule, "severity": r.severity, "cwe": r.cwe, "line": line, "column": column, "sink": sink, "at": len(rows)})
    return rows


_FIELDS = "rule_id string, severity string, cwe string, line int, column int, sink string, at int"
_KIND = pa.list_(pa.struct([(n, pa.int32() if t == "int" else pa.string()) for n, t in (x.split() for x in _FIELDS.split(", "))]))


def _run(batches):
    for b in batches:
        found = [found_in(code, language) for code, language in zip(b.column("content").to_pylist(), b.column("language").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("file_path"), b.column("language"), pa.array(found, _KIND)], ["file_path", "language", "found"])


def worth_scanning(language: Column, content: Column) -> Column:
    """Does a file hold any word that its language's rules look for? The others needn't travel to Python."""
    out = F.lit(False)
    for name, rows in RULES.items():
        words = {t.lower().split("(")[0].split(".")[-1].split("::")[-1] for r in rows for t in r.callees}
        words |= {"unsafe"} if name == "rust" else set(SECRET_NAMES) if name == "python" else set()
        out = out | ((language == name) & F.lower(content).rlike("|".join(sorted(map(re.escape, words)))))
    return out


def call_findings(files: DataFrame) -> DataFrame:
    """One finding for each rule and call of (file_path, language, content) files in the ten languages; confidence medium, low in tests."""
    ship(files.sparkSession)
    rows = files.where(F.col("language").isin(*RULES) & worth_scanning(F.col("language"), F.col("content"))).select("file_path", "language", normalise(F.col("content")).alias("content"))
    rows = rows.mapInArrow(_run, f"file_path string, language string, found array<struct<{', '.join(x.replace(' ', ':') for x in _FIELDS.split(', '))}>>")
    rows = rows.select("file_path", "language", F.explode("found").alias("f"))
    null = F.lit(None).cast("string")
    return rows.select(
        "file_path", "language", "f.line", F.lit("").alias("line_text"), "f.rule_id", "f.severity", "f.column", F.lit(10).alias("length"),
        F.when(F.col("f.sink").isNull(), "A name for secrets holds a literal").otherwise(F.concat(F.lit("Look at what reaches "), F.col("f.sink"))).alias("message"), F.lit("").alias("explanation"), F.lit("").alias("fix"),
        "f.cwe", F.when(is_test_path(F.col("file_path")), "low").otherwise("medium").alias("confidence"), null.alias("source"), "f.sink", null.alias("dataflow_path"),
        F.lit("call").alias("analyzer"), F.lit(2).alias("layer_ord"), F.col("f.at").alias("rule_ord"),
    )
