"""Lookups and texts: weakness knowledge, severity texts, file contexts, attack techniques, explanations and plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import REPORT_RANK, escape, lookup, severity_rank

# Weakness to name; the longer texts are ours.
CWE = {
    "CWE-89": ("SQL Injection", "Input spliced into a statement changes what the database runs.", "Data can be read, changed or deleted.", "Bind parameters; never build statements from text."),
    "CWE-78": ("Command Injection", "Input that reaches a shell can chain further commands.", "The server runs the attacker's code.", "Pass argument lists and no shell."),
    "CWE-79": ("Cross-Site Scripting (XSS)", "Script in a page runs with the viewer's rights.", "Sessions and keystrokes are stolen.", "Write text, not markup; sanitise what must be markup."),
    "CWE-798": ("Hardcoded Credentials", "Whoever reads the source reads the secret.", "One key opens the services behind it.", "Keep secrets in a manager or the environment."),
    "CWE-22": ("Path Traversal", "Names with parent steps leave the intended folder.", "Any file of the server can be read.", "Resolve the path and compare it with the folder."),
    "CWE-502": ("Insecure Deserialization", "Serialised data can create objects that act.", "Reading the data runs code.", "Use formats that hold data only."),
    "CWE-327": ("Weak Cryptography", "Collisions and keys are cheap to find.", "Passwords and signatures don't hold.", "Use current hashes and ciphers."),
}
SEVERITY_TEXT = {
    "critical": "Fix at once: this kind is exploited in practice.",
    "high": "High risk: moderate effort gains much.",
    "medium": "Moderate risk: fix in the current cycle.",
    "low": "Low risk: a weakness to correct.",
}
# Path words, in order; the advice is ours.
FILE_CONTEXT = (
    ("config", "Configuration grants access to what it configures."),
    ("auth", "Authentication code is the boundary."),
    ("api", "Endpoints are probed all the time."),
    ("db", "Database code handles the data itself."),
    ("test", "Test code; its secrets should be fake."),
    ("docs", "Examples should use fake secrets."),
)
METHODS = {"regex": "pattern matching", "ast": "AST-level syntax analysis", "ai": "AI-assisted analysis"}
# Weakness to attack techniques and tactics, with the default.
MITRE = {
    "CWE-89": (("T1190", "T1505"), ("TA0001", "TA0006")),
    "CWE-78": (("T1059", "T1203"), ("TA0002", "TA0001")),
    "CWE-79": (("T1189", "T1059"), ("TA0001", "TA0002")),
    "CWE-798": (("T1552", "T1078"), ("TA0006", "TA0003")),
    "CWE-22": (("T1083", "T1005"), ("TA0007", "TA0009")),
    "CWE-502": (("T1505", "T1059"), ("TA0002", "TA0001")),
    "CWE-327": (("T1600", "T1555"), ("TA0005", "TA0006")),
    "CWE-434": (("T1608", "T1105"), ("TA0011", "TA0011")),
    "CWE-287": (("T1078", "T1110"), ("TA0001", "TA0006")),
    "CWE-918": (("T1190", "T1105"), ("TA0001", "TA0011")),
}
NO_MITRE = (("T1595",), ("TA0043",))
SCORES = {"critical": 90, "high": 70, "medium": 50, "low": 30}


def cwe_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in CWE.items()], "cwe string, name string, attack string, impact string, prevention string")


def mitre_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, list(a), list(b)) for k, (a, b) in MITRE.items()], "cwe string, techniques array<string>, tactics array<string>")


def with_cwe(findings: DataFrame) -> DataFrame:
    """JOIN-2: weakness knowledge by a left join; the table has seven fixed rows, so it is broadcast."""
    return findings.join(F.broadcast(cwe_frame(findings.sparkSession)), "cwe", "left")


def with_severity_text(findings: DataFrame) -> DataFrame:
    """JOIN-3."""
    return findings.withColumn("severity_text", lookup(F.col("severity"), SEVERITY_TEXT))


def file_contexts(path: Column) -> Column:
    """JOIN-4: the advice for every word that the path holds, in table order."""
    return F.array_compact(F.array(*[F.when(F.lower(path).contains(word), F.lit(text)) for word, text in FILE_CONTEXT]))


def with_mitre(findings: DataFrame) -> DataFrame:
    """JOIN-5: techniques and tactics, with the default for other weaknesses; ten fixed rows are broadcast."""
    none = lambda xs: F.array(*[F.lit(x) for x in xs])
    rows = findings.join(F.broadcast(mitre_frame(findings.sparkSession)), "cwe", "left")
    return rows.withColumn("techniques", F.coalesce("techniques", none(NO_MITRE[0]))).withColumn("tactics", F.coalesce("tactics", none(NO_MITRE[1])))


def with_signals(findings: DataFrame, summary: DataFrame) -> DataFrame:
    """JOIN-7: the one row of a threat summary attached to every finding, its counts as flags."""
    one = summary.limit(1).select((F.col("active_attackers") > 0).alias("attacker_aligned"), (F.col("bait_reads") > 0).alias("deception_correlated"), (F.col("breach_hits") > 0).alias("breach_aligned"))
    return findings.crossJoin(F.broadcast(one))  # one row


def explanation(with_knowledge: DataFrame) -> DataFrame:
    """INT-4: the composed text; sections without content are left out. Takes findings after :func:`with_cwe`."""
    section = lambda title, *cols: F.when(F.col("name").isNotNull(), F.concat(F.lit("\n" + title), *[F.concat(F.lit("\n"), c) for c in cols]))
    flow = (F.coalesce("source", F.lit("")) != "") & (F.coalesce("sink", F.lit("")) != "")
    parts = [
        F.concat(F.lit("Found with severity "), F.upper("severity"), F.lit(": **"), F.col("rule_id"), F.lit("**")),
        F.concat(F.lit("Detection method: "), lookup(F.col("analyzer"), METHODS, "analysis")),
        F.when(F.col("line") != 0, F.concat(F.lit("Location: "), F.col("file_path"), F.lit(":"), F.col("line").cast("string"))),
        F.when(flow, F.concat(F.lit("Data flow: "), F.col("source"), F.lit(" → "), F.col("sink"))),
        F.when(F.col("name").isNotNull(), F.concat(F.lit("\nWHAT IS "), F.upper("name"), F.lit("?\n"), F.col("attack"))),
        section("HOW BAD IS THIS?", F.col("impact")),
        section("HOW TO FIX:", F.col("prevention")),
        F.concat(F.lit("\nPRIORITY: "), lookup(F.col("severity"), SEVERITY_TEXT)),
        *[F.when(F.lower("file_path").contains(word), F.lit(f"\nCONTEXT: {text}")) for word, text in FILE_CONTEXT],
        F.when(F.coalesce("fix", F.lit("")) != "", F.concat(F.lit("\nSPECIFIC FIX: "), F.col("fix"))),
    ]
    return with_knowledge.withColumn("explanation", F.array_join(F.array_compact(F.array(*parts)), "\n"))


def feedback(findings: DataFrame, confidence: float = 0.8) -> DataFrame:
    """SCO-8: priority, vector and complexity by weakness prefixes (so that of CWE-798 counts as network, as CWE-79 is its prefix)."""
    cwe = F.coalesce("cwe", F.lit(""))
    vector = F.when(cwe.startswith("CWE-89") | cwe.startswith("CWE-79") | cwe.startswith("CWE-918"), "network").when(cwe.startswith("CWE-78"), "adjacent").otherwise("local")
    complexity = F.when(cwe.startswith("CWE-798") | cwe.startswith("CWE-327"), "low").when(cwe.startswith("CWE-89") | cwe.startswith("CWE-78"), "medium").otherwise("high")
    score = F.floor(lookup(F.col("severity"), SCORES, 50) * F.lit(confidence) + F.lit(0.5)).cast("int")
    return with_mitre(findings).withColumns({"attack_vector": vector, "complexity": complexity, "priority_score": score})


def feedback_summary(scored: DataFrame) -> DataFrame:
    """AGG-7: totals by band."""
    p = F.col("priority_score")
    return scored.agg(F.count("*").alias("total"), F.count_if(p >= 80).alias("critical"), F.count_if((p >= 60) & (p < 80)).alias("high"))


def remediation_order(findings: DataFrame) -> DataFrame:
    """SRT-2: by severity, surest first."""
    sure = lookup(F.col("confidence"), {"high": 0, "medium": 1, "low": 2}, 3)
    return findings.orderBy(severity_rank(F.col("severity"), REPORT_RANK), sure, "file_path", "line", "rule_id")


# Weakness to category of the 2021 list of the ten most critical web risks.
OWASP = {
    "CWE-22": "A01", "CWE-601": "A01", "CWE-327": "A02", "CWE-338": "A02", "CWE-916": "A02", "CWE-20": "A03", "CWE-78": "A03", "CWE-79": "A03", "CWE-89": "A03", "CWE-95": "A03", "CWE-98": "A03", "CWE-917": "A03", "CWE-943": "A03",
    "CWE-434": "A04", "CWE-693": "A05", "CWE-942": "A05", "CWE-287": "A07", "CWE-798": "A07", "CWE-502": "A08", "CWE-915": "A08", "CWE-918": "A10",
}


def with_owasp(findings: DataFrame) -> DataFrame:
    """DOC-5: adds ``owasp``, the weakness's category, or null."""
    return findings.withColumn("owasp", lookup(F.col("cwe"), OWASP))


def with_kev(findings: DataFrame, exploited: DataFrame) -> DataFrame:
    """DOC-5: adds ``kev``: is the weakness among those of a (cwe) catalog of exploited vulnerabilities? One row a weakness reaches the join."""
    known = exploited.where("cwe is not null").select(F.col("cwe").alias("__cwe")).distinct()
    return findings.join(known, F.col("cwe") == F.col("__cwe"), "left").withColumn("kev", F.col("__cwe").isNotNull()).drop("__cwe")


def elevate(findings: DataFrame, exploited: Column, interactive: Column, phishing: Column) -> DataFrame:
    """SCO-9: severity raised to critical by signals of the deeper model, given as boolean columns."""
    rule = F.lower("rule_id")
    known = (F.col("rule_id").contains("CVE") | F.col("rule_id").contains("CWE") | rule.rlike("cve|kev|exploit")) & exploited
    runs = F.col("severity").isin("critical", "high") & rule.rlike("command|rce|deserial") & interactive
    lures = rule.rlike("phish|xss") & phishing
    up = F.coalesce(known | runs | lures, F.lit(False))
    return findings.withColumn("severity", F.when(up, "critical").otherwise(F.col("severity"))).withColumn("confidence", F.when(up, "high").otherwise(F.col("confidence")))


# Training modules (id, title, weakness, minutes, right answer); questions and answers are ours.
MODULES = (
    ("sql-injection-101", "SQL Injection", "CWE-89", 15, 1, "critical", "What keeps a value from changing a statement?", ("Doubling its quotes", "Binding it as a parameter", "Checking its length")),
    ("xss-prevention", "XSS Prevention", "CWE-79", 12, 1, "high", "How does text from a visitor get into a page safely?", ("Through innerHTML", "Through textContent", "Inside a comment")),
    ("secrets-management", "Secrets Management", "CWE-798", 10, 2, "critical", "Where does a service's key belong?", ("In the source", "In the image", "In a secret store")),
)


def training_modules(spark: SparkSession) -> DataFrame:
    """INT-8: the static training table."""
    return spark.createDataFrame([(*m[:7], list(m[7])) for m in MODULES], "id string, title string, cwe string, minutes int, right int, severity string, question string, answers array<string>")


def module_pages(modules: DataFrame) -> DataFrame:
    """INT-8: (id, html) a module's page with what is known of its weakness and its quiz, all values escaped."""
    rows = with_cwe(modules)
    button = lambda x, i: F.concat(F.lit("<button data-i='"), i.cast("string"), F.lit("'>"), escape(x), F.lit("</button>"))
    quiz = F.concat(F.lit("<div class='quiz'><p>"), escape(F.col("question")), F.lit("</p>"), F.array_join(F.transform("answers", button), ""), F.lit("</div>"))
    head = F.concat(F.lit("<h1>"), escape(F.col("title")), F.lit("</h1><span class='"), escape(F.col("severity")), F.lit("'>"), escape(F.upper("severity")), F.lit("</span> <span>"), escape(F.col("cwe")), F.lit("</span>"))
    texts = [F.concat(F.lit("<p>"), escape(F.col(c)), F.lit("</p>")) for c in ("attack", "impact", "prevention")]
    return rows.select("id", F.concat(F.lit("<!DOCTYPE html><html><body>"), head, *texts, quiz, F.lit("</body></html>")).alias("html"))


def check_quiz(answers: DataFrame) -> DataFrame:
    """INT-8: (id, selected) answers with whether they are right; null for unknown modules."""
    modules = training_modules(answers.sparkSession).select("id", "right")
    return answers.join(F.broadcast(modules), "id", "left").withColumn("correct", F.col("selected") == F.col("right"))  # three fixed rows
