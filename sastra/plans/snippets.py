"""Small code samples on which the rules for programming languages are exercised, as data for queries and their SQL alike."""

from __future__ import annotations

#: (language, line) samples; the file of sample i is app/s<i>.<language>.
LINES = (
    ("python", 'run_sql("x"); execute(base + tail)'),
    ("python", 'os.system("ls " + target)'),
    ("javascript", "coll.find({ name: req.query.who })"),
    ("javascript", "box.innerHTML = note"),
    ("javascript", "go(document.referrer)"),
    ("python", 'token = "zz-9876543210"'),
    ("python", "d = hashlib.sha1(pw)"),
    ("java", 'Cipher.getInstance("DES")'),
    ("javascript", "let r = Math.random()"),
    ("python", "fh = open(root + name)"),
    ("php", "upload.single"),
    ("python", "cfg = yaml.load(blob)"),
    ("python", 'h["Access-Control-Allow-Origin"] = "*"'),
    ("javascript", "app.use(helmet());"),
    ("javascript", "res.redirect(req.query.to)"),
    ("javascript", "const m = new RegExp(head + tail)"),
    ("typescript", "<p dangerouslySetInnerHTML={{__html: v}} />"),
    ("javascript", "app.set('trust proxy', 1)"),
    ("go", 'db.Exec("DELETE FROM t WHERE id = %d", n)'),
    ("go", "n := rand.Intn(9)"),
    ("go", 'key = "abcdefgh12"'),
    ("go", 'key := "abcdefgh12"'),
    ("go", "v := template.HTML(s)"),
    ("rust", "unsafe { p.read() }"),
    ("rust", 'secret = "abcdefgh"'),
    ("rust", 'let c = Command::new("ls");'),
    ("rust", "let h = Sha1::new();"),
    ("c", "strcpy(a, b);"),
    ("cpp", "auto t = new Thing;"),
    ("cpp", 'q << "SELECT id FROM t";'),
    ("csharp", 'String.Format("SELECT {0}", v)'),
    ("csharp", 'new SqlCommand("select " + id)'),
    ("csharp", 'connString = "Server=s;pwd=x"'),
    ("csharp", "BinaryFormatter.Deserialize(s)"),
    ("ruby", 'User.where("n = #{n}")'),
    ("ruby", 'system("ls #{d}")'),
    ("ruby", "User.create(params[:u])"),
    ("ruby", "Marshal.load(s)"),
    ("python", 'cur.execute("SELECT 1 WHERE a = ?", (v,))'),
    ("python", 'pw = os.environ["PW"]'),
    ("javascript", "box.textContent = note"),
    ("python", "cfg = yaml.safe_load(blob)"),
    ("rust", "let unsafe_count = 0;"),
    ("go", 'db.Query("SELECT 1 WHERE a = ?", v)'),
    ("javascript", "exec(cmd, req.query.x)"),
    ("php", "mysqli_query($c, $q);"),
    ("php", "system($_GET['c']);"),
    ("java", "stmt.executeQuery(request.getParameter(1));"),
    ("typescript", "fetch(req.query.u)"),
    ("kotlin", "db.rawQuery(intent.getStringExtra(k))"),
    ("ruby", "YAML.load(body)"),
    ("python", "cur.execute(request.args)"),
    ("javascript", "const el = box.innerHTML"),
    ("javascript", "eval(user.code)"),
    ("go", 'db.Query(fmt.Sprintf("SELECT %s", x))'),
)

#: Calls with the rules that they raise, each rule at least once: (language, text, ((rule, severity, weakness, line), ...)).
CALLS = (
    ("python", "cur.execute(\n    base +\n    request.args['q'])\n", (("Python: Sql Injection", "critical", "CWE-89", 1),)),
    ("python", "x = 1\nsubprocess.Popen(sys.argv)\n", (("Python: Command Injection", "critical", "CWE-78", 2),)),
    ("python", "page = render_template(form)\n", (("Python: Html Injection", "high", "CWE-79", 1),)),
    ("python", "fh = open(params)\n", (("Python: File Injection", "high", "CWE-22", 1),)),
    ("python", "x = marshal.loads(body)\n", (("Python: Deserialize Injection", "critical", "CWE-502", 1),)),
    ("python", "urlretrieve(cookies)\n", (("Python: Network Injection", "high", "CWE-918", 1),)),
    ("python", "db_password = 'abcdefgh'\npwd = 'short'\ntoken = 'abcdefgh' + tail\n", (("Python: Hardcoded Secret", "critical", "CWE-798", 1),)),
    ("python", "# os.system(request)\nnote = 'os.system(request)'\n", ()),
    ("javascript", "document.write(req.body.a)", (("Cross-Site Scripting", "critical", "CWE-79", 1),)),
    ("javascript", "const out = execSync(\n  `ls`, req.query.x\n)", (("Command Injection", "critical", "CWE-78", 1),)),
    ("javascript", "rows.aggregate(req.body)", (("SQL/NoSQL Injection", "critical", "CWE-89", 1),)),
    ("javascript", "axios(ctx.url)", (("SSRF", "high", "CWE-918", 1),)),
    ("javascript", "/* exec(req.x) */ exec(fixed)", ()),
    ("go", "rows := db.Query(fmt.Sprintf(q, x))", (("Go: SQL Injection", "critical", "CWE-89", 1),)),
    ("go", "out := exec.Command(\n\tr.FormValue(k),\n)", (("Go: Command Injection", "critical", "CWE-78", 1),)),
    ("go", "http.Get(r.URL.Query())", (("Go: SSRF", "high", "CWE-918", 1),)),
    ("rust", "let o = Command::new(env::var(k));", (("Rust: Command Injection", "critical", "CWE-78", 1),)),
    ("rust", "let d = md5(x);\nunsafe { go() }", (("Rust: Weak Crypto", "high", "CWE-327", 1), ("Rust: Unsafe Block", "high", "CWE-119", 2))),
    ("java", "st.createQuery(request.getHeader(h));", (("Java: Sql", "critical", "CWE-89", 1),)),
    ("java", "new InitialContext.lookup(request.getParameter(n));", (("Java: Jndi", "critical", "CWE-917", 1),)),
    ("java", "rt.exec(request.getParameter(c));", (("Java: Command", "critical", "CWE-78", 1),)),
    ("java", "RestTemplate.exchange(\n  request.getQueryString());", (("Java: Ssrf", "high", "CWE-918", 1),)),
    ("java", "readUnshared(request.getCookies());", (("Java: Deserialize", "critical", "CWE-502", 1),)),
    ("java", "out.write(request.getParameter(t));", (("Java: Xss", "high", "CWE-79", 1),)),
    ("java", "void exec(HttpServletRequest r) { }", ()),
    ("php", "eval($x);", (("PHP: Dynamic Code Execution", "critical", "CWE-95", 1),)),
    ("php", "pg_query($c, $q);", (("PHP: SQL Injection", "critical", "CWE-89", 1),)),
    ("php", "passthru($_GET['c']);", (("PHP: Command Injection", "critical", "CWE-78", 1),)),
    ("php", "include $_GET['p'];\nrequire_once($_POST['q']);\ninclude 'fixed.php';", (("PHP: LFI/RFI", "critical", "CWE-98", 1), ("PHP: LFI/RFI", "critical", "CWE-98", 2))),
    ("ruby", "Marshal.restore(x)", (("Ruby: Unsafe Deserialization", "critical", "CWE-502", 1),)),
    ("ruby", 'system "ls #{params[:d]}"', (("Ruby: Command Injection", "critical", "CWE-78", 1),)),
    ("ruby", "User.find_by_sql(params[:q])", (("Ruby: SQL Injection", "critical", "CWE-89", 1),)),
    ("csharp", "ctx.FromSqlRaw(Request.Form[k]);", (("C#: Sql", "critical", "CWE-89", 1),)),
    ("csharp", "BinaryFormatter.Deserialize(HttpContext.Body);", (("C#: Deserialize", "critical", "CWE-502", 1),)),
    ("csharp", "Process.Start(\n  Request.QueryString[c]);", (("C#: Command", "critical", "CWE-78", 1),)),
    ("csharp", "WebRequest.Create(Request.Params[u]);", (("C#: Ssrf", "high", "CWE-918", 1),)),
    ("csharp", "Html.Raw(Request.Cookies[t]);", (("C#: Xss", "high", "CWE-79", 1),)),
    ("typescript", "spawn(req.query.c)", (("TypeScript: Command Injection", "critical", "CWE-78", 1),)),
    ("typescript", "document.write(req.body)", (("TypeScript: XSS", "critical", "CWE-79", 1),)),
    ("typescript", "db.queryRaw(\n  req.body.q\n)", (("TypeScript: SQL Injection", "critical", "CWE-89", 1),)),
    ("typescript", "users.findOne(req.body)", (("TypeScript: NoSQL Injection", "critical", "CWE-943", 1),)),
    ("typescript", "got(req.query.u)", (("TypeScript: SSRF", "high", "CWE-918", 1),)),
    ("kotlin", "view.loadUrl(intent.getData())", (("Kotlin: WebView XSS", "critical", "CWE-79", 1),)),
    ("kotlin", "db.execSQL(intent.getStringExtra(k))", (("Kotlin: SQL Injection", "critical", "CWE-89", 1),)),
    ("kotlin", "startActivity(\n  activity.intent\n)", (("Kotlin: Implicit Intent Hijack", "high", "CWE-927", 1),)),
    ("kotlin", "ProcessBuilder(intent.getExtras())", (("Kotlin: Command Injection", "critical", "CWE-78", 1),)),
)

#: A small application for graphs: (file, text).
APP = (
    ("app/web.py", "def handle(r):\n    q = request.args\n    return fetch_user(q)\n"),
    ("app/db.py", "def fetch_user(q):\n    return cursor.execute(q)\n\ndef idle():\n    return 1\n"),
    ("app/cli.py", "def main():\n    a = sys.argv\n    return show(a)\n\ndef show(a):\n    return a\n"),
)

#: Python files for the syntax-tree layer.
PYTHON = (
    ("app/a.py", 'import os, pickle\npassword = "hunter2hunter2"\ncur.execute("select " + request.args["q"])\nos.system(cmd)\nx = pickle.loads(b)\np = os.path.join(root, name)\n'),
    ("app/b.py", "def broken(:\n"),
    ("app/test_c.py", 'token = "abcdefghijkl"\n'),
    ("app/d.py", 'el.innerHTML = v\n",".join(xs)\nrun(["ls"])\n'),
)


def sql_text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def values(rows) -> str:
    """SQL rows of the samples: VALUES (i, language, line)."""
    return ", ".join(f"({i}, {sql_text(a)}, {sql_text(b)})" for i, (a, b) in enumerate(rows))
