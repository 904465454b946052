"""Call graphs with reachability, and the typed knowledge graph."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.workers import ship

# Tokens that make a function a source or a sink.
SOURCE_TOKENS = ("req.query", "req.body", "req.params", "request.args", "request.form", "input(", "sys.argv", "os.getenv")
SINK_TOKENS = ("execute(", "cursor.execute", "innerhtml", "eval(", "exec(", "os.system(", "subprocess", "pickle.loads", "yaml.load(", "document.write")
SUFFIXES = (".py", ".js", ".ts", ".go", ".rs")
_DEFINITION = re.compile(r"(?:async def|def|function)\s+(\w+)\s*\(|(\w+)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>")
# Weights of the knowledge graph's links.
WEIGHTS = {"detected_in": 1.0, "maps_to": 0.9, "technique": 0.7, "correlated_with": 0.6, "fixed_by": 1.0, "feedback_on": 0.8}


def functions_of(code: str | None) -> list[tuple[str, str]]:
    """GRA-1: (name, body) of each function by indentation; a later function of the same name wins.

    Blank lines and comments don't count. A body runs from its definition to the next definition, or to the first line before it that isn't indented deeper.
    """
    lines = [(len(x) - len(x.lstrip()), x, _DEFINITION.match(x.strip())) for x in (code or "").split("\n") if x.strip() and not x.strip().startswith(("#", "//"))]
    heads = [i for i, (_, _, m) in enumerate(lines) if m]
    found = {}
    for i, following in zip(heads, [*heads, len(lines)][1:], strict=True):
        depth, _, m = lines[i]
        shallow = (j for j in range(i + 1, following) if lines[j][0] <= depth)
        found[m[1] or m[2]] = "\n".join(x for _, x, _ in lines[i : next(shallow, following)])
    return list(found.items())


def _extract(batches):
    kind = pa.list_(pa.struct([("name", pa.string()), ("body", pa.string())]))
    for b in batches:
        found = [[{"name": n, "body": t} for n, t in functions_of(code)] for code in b.column("content").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("file_path"), b.column("content"), pa.array(found, kind)], ["file_path", "content", "found"])


def functions(files: DataFrame, limit: int | None = None) -> DataFrame:
    """(file_path, name, body, calls): functions of the files in the five suffixes, with the names called anywhere in their file (GRA-2). ``limit`` takes the first files by path (SRC-8)."""
    ship(files.sparkSession)
    rows = files.where(F.col("file_path").rlike("(" + "|".join(s.replace(".", r"\.") for s in SUFFIXES) + ")$")).select("file_path", "content")
    if limit is not None:
        rows = rows.orderBy("file_path").limit(limit)
    rows = rows.mapInArrow(_extract, "file_path string, content string, found array<struct<name:string,body:string>>")
    called = F.array_distinct(F.regexp_extract_all("content", F.lit(r"(\w+)\s*\("), F.lit(1)))
    return rows.select("file_path", called.alias("calls"), F.explode("found").alias("f")).select("file_path", F.col("f.name").alias("name"), F.col("f.body").alias("body"), "calls")


def call_edges(funcs: DataFrame, strict: bool = False) -> DataFrame:
    """GRA-3: (src, dst) edges: a name called in the file that the body holds (JOIN-10). ``strict`` wants it as a whole word before a bracket and not the function itself."""
    edge = funcs.select("name", "body", F.explode("calls").alias("dst"))
    inside = F.expr("body rlike concat('(^|[^A-Za-z0-9_])', dst, '[ ]*[(]')") & (F.col("dst") != F.col("name")) if strict else F.contains("body", F.col("dst"))
    return edge.where(inside).select(F.col("name").alias("src"), "dst").distinct()


def _tagged(funcs: DataFrame, tokens) -> DataFrame:
    body = F.lower("body")
    hit = F.lit(False)
    for t in tokens:
        hit = hit | body.contains(t)
    return funcs.where(hit).select("name").distinct()


def sources(funcs: DataFrame) -> DataFrame:
    return _tagged(funcs, SOURCE_TOKENS)


def sinks(funcs: DataFrame) -> DataFrame:
    return _tagged(funcs, SINK_TOKENS)


def shortest_paths(edges: DataFrame, starts: DataFrame, ends: DataFrame) -> DataFrame:
    """GRA-4: (source, sink, path array, length in functions): a shortest path from each source to each sink it reaches; ties by path text.

    Frontiers advance one hop a round and keep one path for each (source, function), so the work is bounded by pairs, not by
    paths. A function that is both gives [f, f]. Stops when a round finds nothing new.
    """
    edges = cut(edges.select("src", "dst").distinct())
    starts, ends = starts.select(F.col("name").alias("source")), ends.select(F.col("name").alias("sink"))
    seen = starts.select("source", F.col("source").alias("at"), F.array("source").alias("path"))
    frontier = seen
    while True:
        step = frontier.join(edges, frontier["at"] == edges["src"]).select("source", F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"))
        step = step.groupBy("source", "at").agg(F.min_by("path", F.array_join("path", "\u0001")).alias("path"))
        frontier = cut(step.join(seen.select("source", "at"), ["source", "at"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
    reached = seen.join(ends, seen["at"] == ends["sink"])
    own = F.when(F.size("path") == 1, F.concat("path", F.array("sink"))).otherwise(F.col("path"))
    return reached.select("source", "sink", own.alias("path")).withColumn("length", F.size("path"))


#: Longest piece of a name that text is looked up by.
GRAM = 3


def _named_in(files: DataFrame, names: DataFrame, as_: str) -> DataFrame:
    """(file_path, as_): the first of ``names`` that the file's text holds anywhere, without case.

    A name has word characters only, so it lies inside one word. Distinct words and names meet by the name's first characters, an
    equi-join, and what met is compared; neither files nor names are broadcast.
    """
    words = files.select("file_path", F.explode(F.array_distinct(F.split(F.lower("content"), r"[\x00-/:-@\[-^`{-\x7f]+"))).alias("word")).where("word <> ''")
    at = F.sequence(F.lit(1), F.length("word"))
    pieces = F.array_distinct(F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(1), F.lit(GRAM)), lambda n: F.substr("word", i, n)))))
    vocabulary = words.select("word").distinct().select("word", F.explode(pieces).alias("piece"))
    wanted = names.select("name", F.lower("name").alias("low")).withColumn("piece", F.substring("low", 1, GRAM))
    met = vocabulary.join(wanted, "piece").where(F.contains("word", F.col("low"))).groupBy("word").agg(F.min("name").alias(as_))
    return words.join(met, "word").groupBy("file_path").agg(F.min(as_).alias(as_))


def verdicts(findings: DataFrame, files: DataFrame, funcs: DataFrame, edges: DataFrame) -> DataFrame:
    """GRA-5, GRA-6: findings with ``reachability`` (status, source, sink, path, reason).

    The verdict of a path counts for all findings, as there is one call graph; without a path a finding whose file names both a source and a sink
    function is conditionally reachable (JOIN-11); else it is unreachable.
    """
    a, b = sources(funcs), sinks(funcs)
    best = shortest_paths(edges, a, b).orderBy("length", F.array_join("path", " ")).limit(1)
    best = best.select(F.lit("REACHABLE").alias("status"), "source", "sink", F.array_join("path", " → ").alias("path"))
    both = _named_in(files, a, "cs").join(_named_in(files, b, "ck"), "file_path").withColumnRenamed("file_path", "__p")
    ready = a.limit(1).select(F.lit(1).alias("x")).crossJoin(b.limit(1).select(F.lit(1).alias("y"))).agg(F.count("*").alias("ready"))  # one row
    rows = findings.join(both, findings["file_path"] == both["__p"], "left").drop("__p").crossJoin(F.broadcast(ready))
    rows = rows.join(F.broadcast(best.withColumnRenamed("source", "bs").withColumnRenamed("sink", "bk").withColumnRenamed("path", "bp")), F.lit(True), "left")  # one row
    flow = F.concat("cs", F.lit(" ⇢ "), "ck", F.lit(" (unsanitized data flow detected)"))
    reach = (
        F.when(F.col("ready") == 0, _verdict("UNREACHABLE", reason="no_sources_or_sinks_found"))
        .when(F.col("status").isNotNull(), _verdict("REACHABLE", F.col("bs"), F.col("bk"), F.col("bp")))
        .when(F.col("cs").isNotNull(), _verdict("CONDITIONALLY_REACHABLE", F.col("cs"), F.col("ck"), flow))
        .otherwise(_verdict("UNREACHABLE", reason="no_path_from_source_to_sink"))
    )
    return rows.withColumn("reachability", reach).drop("cs", "ck", "ready", "status", "bs", "bk", "bp")


def _verdict(status: str, source=None, sink=None, path=None, reason: str | None = None):
    null = F.lit(None).cast("string")
    return F.struct(F.lit(status).alias("status"), (null if source is None else source).alias("source"), (null if sink is None else sink).alias("sink"), (null if path is None else path).alias("path"), F.lit(reason).cast("string").alias("reason"))


# ---------------------------------------------------------------- knowledge graph


def upsert_nodes(nodes: DataFrame, order: str = "seq") -> DataFrame:
    """DED-3: the last node of each id."""
    rest = [c for c in nodes.columns if c not in ("id", order)]
    return nodes.groupBy("id").agg(F.max_by(F.struct(*rest), order).alias("n")).select("id", "n.*")


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """JOIN-8: edges whose ends both exist."""
    ids = nodes.select("id").distinct()
    return edges.join(ids, edges["src"] == ids["id"], "left_semi").join(ids, edges["dst"] == ids["id"], "left_semi")


def link(pairs: DataFrame, kind: str, weight: str | None = None) -> DataFrame:
    """GRA-8: (src, dst) pairs as typed edges with the kind's fixed weight."""
    return pairs.select("src", "dst", F.lit(kind).alias("type"), F.lit(WEIGHTS[weight or kind]).alias("weight"))


def export_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """GRA-10: the whole graph as two tables below ``path``; an earlier export is replaced."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def graph_scores(findings: DataFrame, edges: DataFrame) -> DataFrame:
    """AGG-10: (id, score): +30 if it maps to something, +40 if correlated, +20 without a fix; 0 without edges; 100 at most."""
    has = lambda kind: F.max((F.col("type") == kind).cast("int"))
    out = edges.groupBy("src").agg(has("maps_to").alias("m"), has("correlated_with").alias("c"), has("fixed_by").alias("f"))
    value = F.least(F.col("m") * 30 + F.col("c") * 40 + (1 - F.col("f")) * 20, F.lit(100))
    return findings.select("id").join(out, findings["id"] == out["src"], "left").select("id", F.when(F.col("m").isNull(), 0).otherwise(value).alias("score"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """AGG-8: one row for each node type, and one each for all nodes and all edges."""
    by = nodes.groupBy(F.concat(F.lit("type:"), "type").alias("what")).agg(F.count("*").alias("n"))
    return by.union(nodes.agg(F.lit("nodes"), F.count("*"))).union(edges.agg(F.lit("edges"), F.count("*")))


def distances(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """DOC-5: (start, id, hops): every node that a start reaches over (src, dst) dependencies, itself at 0, with the fewest hops. Frontiers advance until none is left."""
    edges = cut(edges.select("src", "dst").distinct())
    seen = cut(starts.select(F.col("id").alias("start"), "id").distinct().withColumn("hops", F.lit(0)))
    frontier, hops = seen, 0
    while not frontier.isEmpty():
        hops += 1
        step = frontier.join(edges, frontier["id"] == edges["src"]).select("start", F.col("dst").alias("id")).distinct()
        frontier = cut(step.join(seen.select("start", "id"), ["start", "id"], "left_anti").withColumn("hops", F.lit(hops)))
        seen = cut(seen.union(frontier))
    return seen


def attack_paths(start: DataFrame, edges: DataFrame) -> DataFrame:
    """GRA-9: (id, path array): all simple paths from each start that end where no edge leaves, however long.

    All paths are wanted, so the result itself may be large. Walks advance one edge a round, so nothing is collected; no
    node comes twice in a walk, so the rounds end.
    """
    edges = cut(edges.select("src", "dst").distinct())
    walks = cut(start.select("id").distinct().select("id", F.col("id").alias("at"), F.array("id").alias("path")))
    found = walks.select("id", "path").limit(0)
    parts = 0
    while not walks.isEmpty():
        found = found.unionByName(walks.join(edges, walks["at"] == edges["src"], "left_anti").select("id", "path"))
        parts += 1
        if parts % 16 == 0:  # the plan stays short
            found = cut(found)
        step = walks.join(edges, walks["at"] == edges["src"]).where(~F.array_contains("path", F.col("dst")))
        walks = cut(step.select("id", F.col("dst").alias("at"), F.array_append("path", F.col("dst")).alias("path")))
    return cut(found)
