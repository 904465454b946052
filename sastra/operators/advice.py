"""What is said about each line rule: message, explanation, fix, and an example with a bad and a good form. All texts are ours."""

from __future__ import annotations

#: Rule to (message, explanation, fix, bad form, good form).
ADVICE = {
    "SQL Injection": ("SQL text is glued together from parts", "Whoever controls one part can end the literal and add statements of their own.", "Send the statement with placeholders and hand the values over as parameters.", 'cur.execute("... id = " + key)', 'cur.execute("... id = ?", (key,))'),
    "Command Injection": ("A command line is built by concatenation", "A semicolon or a backtick in the spliced part starts a second program.", "Start the program with an argument list and without a shell.", 'os.system("tar xf " + name)', 'subprocess.run(["tar", "xf", name], check=True)'),
    "NoSQL Injection": ("Request data goes into a document query as it is", "A client may send an object with operators where a plain value was meant, and so match every document.", "Cast each field to the type that is wanted and refuse keys that begin with a dollar sign.", "users.find({ name: req.body.name })", "users.find({ name: String(req.body.name) })"),
    "Cross-Site Scripting (XSS)": ("Markup is written into the page from a value", "Markup in that value is parsed, and its scripts act for the visitor.", "Write the value as text; where markup is wanted, clean it with an allow list first.", "box.innerHTML = note", "box.textContent = note"),
    "DOM-based XSS": ("The page reads its own address or referrer", "A prepared link puts text into these values; reaching a sink, it runs in the browser and never passes the server.", "Parse the address, take out the one field that is needed and check it before use.", "show(document.referrer)", "show(new URL(document.referrer).hostname)"),
    "Hardcoded Secret": ("A credential stands in the source", "Everyone with a clone, a build log or an old backup can use it, and it outlives the commit that removes it.", "Read it from a secret store or the environment, and revoke the one that leaked.", 'token = "f3c1..."', 'token = os.environ["APP_TOKEN"]'),
    "Weak Password Storage": ("A password meets a fast digest or none", "Fast digests let a graphics card try billions of guesses a second once the table leaks.", "Store passwords with argon2, scrypt or bcrypt and a salt of their own.", "hashlib.md5(pw)", "argon2.PasswordHasher().hash(pw)"),
    "Weak Cryptographic Algorithm": ("An outdated cipher or digest is named", "Collisions or keys of these algorithms are within reach of ordinary hardware.", "Use SHA-256 or later for digests and AES-GCM or ChaCha20-Poly1305 for encryption.", 'Cipher.getInstance("DES")', 'Cipher.getInstance("AES/GCM/NoPadding")'),
    "Insecure Random": ("A predictable generator is used", "After a few outputs its state, and so every later value, can be worked out.", "Draw tokens and keys from the operating system's generator.", "Math.random()", "crypto.getRandomValues(new Uint8Array(16))"),
    "Path Traversal": ("A file name is put together from parts", "Parent steps in a part lead out of the folder that was meant.", "Resolve the whole path and check that it still lies below the folder.", "open(root + name)", "open(safe_below(root, name))"),
    "Arbitrary File Upload": ("An upload is stored without a filter", "A script or a page among the uploads may be run or served from the site itself.", "Check type and size, choose the stored name yourself and keep files outside the served folder.", 'upload.single("f")', 'multer({ fileFilter, limits }).single("f")'),
    "Insecure Deserialization": ("Objects are rebuilt from a byte stream", "Such streams may name any class, and building the object already calls its code.", "Exchange plain data such as JSON and check it against a schema.", "pickle.loads(blob)", "json.loads(blob)"),
    "CORS Misconfiguration": ("Any origin may read the answers", "Every site that a visitor opens can call this one and read what comes back.", "Answer with the one origin that asked, if it is on a list.", 'h["Access-Control-Allow-Origin"] = "*"', 'h["Access-Control-Allow-Origin"] = known(origin)'),
    "Missing Security Headers": ("Response headers stay at their defaults", "Defaults leave framing, script sources and transport looser than the application needs.", "State the content policy and transport rules that fit the application.", "app.use(helmet());", "app.use(helmet({ contentSecurityPolicy: policy }));"),
    "Open Redirect": ("The target of a redirect comes from the request", "A link that begins with this site's name can end on a copy of it.", "Redirect to paths of this site or to targets from a table only.", "res.redirect(req.query.to)", 'res.redirect(TARGETS[req.query.to] ?? "/")'),
    "ReDoS (Regular Expression Denial of Service)": ("A regular expression is compiled from input", "A pattern or text made for backtracking keeps the process busy for minutes.", "Escape the input before it becomes a pattern, or search for it as plain text.", "new RegExp(head + tail)", "text.includes(tail)"),
    "React dangerouslySetInnerHTML": ("A component renders raw markup", "The framework's escaping is switched off for this value, so scripts in it reach the page.", "Render children as text, or clean the markup just before it is rendered.", "<p dangerouslySetInnerHTML={{__html: v}} />", "<p>{v}</p>"),
    "Express Trust Proxy": ("Forwarded headers are believed", "Clients that reach the server past the proxy can then name any address as their own.", "Name the proxies that may set these headers.", "app.set('trust proxy', true)", "app.set('trust proxy', '10.0.0.0/8')"),
    "Go: SQL Injection (database/sql)": ("A statement holds a format verb", "Formatting quotes nothing, so the value can change the statement.", "Pass the value as an argument of the call.", 'db.Query("... id = %d", id)', 'db.Query("... id = ?", id)'),
    "Go: Insecure Random (math/rand)": ("Values come from math/rand", "The sequence follows from its seed, so tokens made of it can be foretold.", "Read from crypto/rand wherever a value must not be guessed.", "rand.Intn(1e6)", "rand.Int(crand.Reader, limit)"),
    "Go: Hardcoded Secret": ("A string literal serves as credential", "It is part of the binary too, where a plain search for strings finds it.", "Load it at start from the environment or a mounted file.", 'token := "k9..."', 'token := os.Getenv("APP_TOKEN")'),
    "Go: Unescaped HTML Template": ("A template value is declared safe", "The template engine trusts such types and leaves their content unescaped.", "Hand plain strings to the template and let it escape them.", "template.HTML(s)", "s"),
    "Rust: Unsafe Block": ("An unsafe block opens here", "Inside it the compiler checks neither lifetimes nor aliasing, so one slip corrupts memory.", "Keep the block small, state what it relies on, and wrap it in a safe function.", "unsafe { *p }", "slice.get(i)"),
    "Rust: Hardcoded Secret": ("A credential is bound to a literal", "Release binaries carry the literal along in clear text.", "Read it with std::env::var or from a vault at start.", 'let api_key = "..."', 'let api_key = std::env::var("API_KEY")?'),
    "Rust: Use of eval/exec": ("Another program is started", "Arguments from outside choose what that program does; through a shell they choose the program as well.", "Keep the program's name fixed and check each argument before it is passed.", 'Command::new(name)', 'Command::new("/usr/bin/tar").arg(checked)'),
    "Rust: Weak Crypto (MD5/SHA1)": ("An MD5 or SHA-1 digest is computed", "Two inputs of equal digest can be made at will, so it proves nothing.", "Take sha2 or blake3.", "Sha1::new()", "Sha256::new()"),
    "C++: Buffer Overflow (strcpy/sprintf/gets)": ("A copy without a length", "Input longer than the target overwrites what lies behind it, return addresses included.", "Use the variants that take the target's size, or std::string.", "strcpy(a, b);", "std::string a = b;"),
    "C++: Memory Leak (new without delete)": ("Memory is allocated by hand", "Each path that skips the delete, exceptions among them, keeps the memory until the process ends.", "Let std::unique_ptr or std::make_shared own it.", "auto t = new Thing;", "auto t = std::make_unique<Thing>();"),
    "C++: SQL Injection": ("SQL is assembled by formatting", "The formatted value is parsed as part of the statement.", "Prepare the statement and bind the values.", 'q << "SELECT ... " << id', "stmt.bind(1, id);"),
    "C#: SQL Injection (string concatenation)": ("A database command is concatenated", "Quotes in the added value end the literal and let it speak SQL.", "Add the values to the command's Parameters.", 'new SqlCommand("... " + id)', 'cmd.Parameters.AddWithValue("@id", id)'),
    "C#: Hardcoded Connection String": ("A connection string carries its login", "The configuration of a running copy and its source then open the database alike.", "Use integrated authentication or read the login from a vault.", 'connString = "...;pwd=x"', 'connString = vault["db"]'),
    "C#: Insecure Deserialization": ("A formatter that restores arbitrary types", "The stream names the types, and some of them run commands while they are restored.", "Use System.Text.Json with fixed types.", "new BinaryFormatter().Deserialize(s)", "JsonSerializer.Deserialize<T>(s)"),
    "Ruby: SQL Injection (ActiveRecord)": ("A query string interpolates a value", "Interpolation comes before ActiveRecord sees the string, so nothing is quoted.", "Pass a hash, or a string with placeholders and its values.", 'where("n = \'#{n}\'")', "where(n: n)"),
    "Ruby: Command Injection (system/exec/backticks)": ("A shell line interpolates a value", "The shell splits the line and runs whatever the value adds.", "Give the program and its arguments as separate strings.", 'system("ls #{d}")', 'system("ls", d)'),
    "Ruby: Mass Assignment": ("Request parameters fill a record unchecked", "A client can set columns that no form shows, such as a role.", "Permit the fields by name.", "User.create(params[:u])", "User.create(params.require(:u).permit(:name))"),
    "Ruby: Unsafe Deserialization (YAML/Marshal)": ("Ruby objects are loaded from text", "Loading may build any class, which is enough to run code.", "Use YAML.safe_load or JSON.", "YAML.load(body)", "YAML.safe_load(body)"),
}


def example(rule: str) -> str:
    """The rule's example as one text: the bad form, then the good one."""
    _, _, _, bad, good = ADVICE[rule]
    return f"Bad: {bad}\nGood: {good}"
