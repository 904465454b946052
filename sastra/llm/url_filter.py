"""URL filtering by curated rules and by association rules that FP-growth mines from labelled URLs.

A URL becomes a set of tokens: each label of its host, each segment of its path, the names of its query parameters. Labelled URLs
join a token for their class; Spark's FP-growth finds the frequent combinations, and those that imply a class with enough
support and confidence, and that no part of theirs already covers, are kept, whatever their length. A URL is judged through an inverted index from token to rule:
a rule fires if as many of its tokens are found as it has. Curated rules go first. DataFrame and SQL functions only.

Tokens that occur in just the same labelled URLs tell nothing apart, so the first of them stands for all: otherwise k of them would be 2**k - 1 combinations. A URL's tokens
stay in its row until they meet the index, which is counted before it is broadcast; what travels then are the rules that a token is part of, keyed by a hash of the URL's
tokens, so that no group is larger than one set of tokens, however often its URL or a null one is repeated.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, lower_ascii, read

#: Fixed rules: (host, path, verdict).
CURATED = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Of labelled URLs, the part that a combination occurs in at least, and their least number; the part of its URLs that share the class.
SUPPORT, LEAST, CONFIDENCE = 0.002, 3, 0.8
#: Ours: words of a host that mark its URLs as advertising, gambling, adult or spam when labels are made.
MARKS = ("adult", "ads-", "bets", "casino", "lottery", "pills", "poker", "porn", "spam", "viagra")
DEFAULT = "allow"
#: The index of rules (a row for each token of each) is broadcast up to so many rows and characters; a larger one is joined by a shuffle.
BROADCAST_ROWS, BROADCAST_CHARS = 100_000, 20_000_000


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): the host after the first '://', A-Z lower-cased; the path up to '?', '#' or the end. Without '://' both are empty."""
    text = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(text, "://") > 0, F.substr(text, F.instr(text, "://") + F.lit(3))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + F.lit(1)), r"\A[^?#]*", 0)
    return lower_ascii(host), path


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a URL; numbers become one token, as each is nearly unique."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    names = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    labels = F.transform(F.filter(F.split(host, "\\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    steps = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), F.when(x.rlike(r"\A[0-9]+(\.[a-z]+)?\z"), F.lit("#")).otherwise(x)))
    return F.array_distinct(F.concat(labels, steps, names))


def curated(host: Column, path: Column, rules=CURATED) -> Column:
    """The longest rule that fits, as struct(rule, verdict), or null. A rule fits its host and all subdomains if the path starts with the rule's."""
    out = None
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST) -> DataFrame:
    """(rule_id, tokens, verdict, confidence, support) rules mined from (tokens, verdict) rows.

    Null verdicts take no part; repeated rows count as often as they occur. Of tokens that occur in just the same rows the first stands for all. A rule is dropped if a
    rule of some of its tokens has the same verdict at no less confidence. No rows, no rules.
    """
    rows = cut(labelled.where("verdict is not null").select("tokens", "verdict"))
    none = "tokens array<string>, verdict string, confidence double, support double"
    total = rows.count()
    if not total:
        return rows.sparkSession.createDataFrame([], none).withColumn("rule_id", F.lit(""))
    # rows of equal tokens are one row with a weight; a token is known by the sums of two hashes over its rows
    sets = rows.groupBy("tokens").agg(F.count("*").alias("w"))
    token = sets.select(F.explode("tokens").alias("token"), "w", *[F.xxhash64("tokens", F.lit(k)).cast("decimal(38,0)").alias(f"h{k}") for k in (1, 2)])
    known = token.groupBy("token").agg(F.sum("w").alias("n"), F.sum("h1").alias("h1"), F.sum("h2").alias("h2")).where(F.col("n") >= least)
    stands = known.groupBy("n", "h1", "h2").agg(F.min("token").alias("token")).select("token")
    kept = rows.select(F.xxhash64("tokens").alias("key"), "tokens").distinct().select("key", "tokens", F.explode("tokens").alias("token")).join(stands, "token")
    kept = kept.groupBy("key", "tokens").agg(F.array_sort(F.collect_list("token")).alias("few"))  # a URL's tokens
    items = rows.join(kept, "tokens").select(F.array_append("few", F.concat(F.lit("class:"), "verdict")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min(max(support, least / total), 1.0), minConfidence=confidence).fit(items)
    found = cut(model.freqItemsets)
    is_class = lambda x: x.startswith("class:")
    with_class = found.where(F.exists("items", is_class) & (F.size("items") > 1))
    with_class = with_class.select(F.array_sort(F.filter("items", lambda x: ~is_class(x))).alias("tokens"), F.substr(F.filter("items", is_class)[0], F.lit(7)).alias("verdict"), F.col("freq").alias("both"))
    alone = found.where(~F.exists("items", is_class)).select(F.array_sort("items").alias("tokens"), F.col("freq").alias("base"))
    rules = with_class.join(alone, "tokens").select("tokens", "verdict", (F.col("both") / F.col("base")).alias("confidence"), (F.col("both") / F.lit(total)).alias("support"))
    rules = cut(rules.where(F.col("confidence") >= confidence))
    # A part holds its own rarest token, so that one is enough to find the rules it may be part of.
    tokens = rules.select("tokens", "verdict", "confidence", F.explode("tokens").alias("token"))
    tokens = tokens.join(tokens.groupBy("token").agg(F.count("*").alias("n")), "token")
    parts = tokens.groupBy(F.col("tokens").alias("part"), F.col("verdict").alias("v"), F.col("confidence").alias("c")).agg(F.min(F.struct("n", "token"))["token"].alias("token"))
    inside = (F.size("part") < F.size("tokens")) & (F.size(F.array_except("part", "tokens")) == 0)
    covered = tokens.join(parts, "token").where("v = verdict and c >= confidence").where(inside).select("tokens", "verdict").distinct()
    return rules.join(covered, ["tokens", "verdict"], "left_anti").withColumn("rule_id", F.concat_ws(" ", "tokens"))


def judge(pages: DataFrame, labels: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict, mined_rule): the curated rule and its verdict, or else the verdict of the most confident mined rule, or else ``allow``.

    ``labels`` has (key, verdict) with verdict 'allow', 'block' or null; a key with both counts as 'block'. Of equally confident rules the one of more
    support goes first, then 'block', then the last by its tokens. Null URLs have an empty host and path and no tokens; rows that repeat a key are judged one by one.
    Columns of ``pages`` but these two take no part. Without labels all is left to the curated rules.
    """
    rows = pages.select(F.col(key).alias(key), F.col(url).alias("__url")).withColumns({"__host": split_url(F.col("__url"))[0], "__path": split_url(F.col("__url"))[1]})
    rows = rows.withColumn("__fit", curated(F.col("__host"), F.col("__path"))).withColumn("__tokens", tokens_of(F.col("__url"), F.col("__host"), F.col("__path")))
    classes = labels.where(F.col(key).isNotNull()).groupBy(key).agg(F.max("verdict").alias("__class"))
    rules = cut(mine(rows.join(classes, key).select(F.col("__tokens").alias("tokens"), F.col("__class").alias("verdict"))))
    index = rules.select(F.explode("tokens").alias("__token"), "rule_id", F.size("tokens").alias("__need"), F.col("verdict").alias("__v"), "confidence", "support")
    size = index.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("__token") + F.length("rule_id")), F.lit(0)).alias("c")).first()
    if not size["n"]:
        out = rows.withColumn("__best", F.lit(None).cast("struct<rule_id:string,v:string>"))
    else:
        # equal sets of tokens are judged once
        asked = rows.where("__fit is null").select(F.array_sort("__tokens").alias("__set")).distinct()
        hits = asked.select("__set", F.explode("__set").alias("__token"))
        hits = hits.join(F.broadcast(index) if size["n"] <= BROADCAST_ROWS and size["c"] <= BROADCAST_CHARS else index, "__token")
        fired = hits.groupBy("__set", "rule_id", "__need", "__v", "confidence", "support").agg(F.count("*").alias("n")).where("n = __need")
        best = fired.groupBy("__set").agg(F.max(F.struct("confidence", "support", F.col("__v").alias("v"), "rule_id")).alias("__best"))
        best = best.withColumn("__key", F.xxhash64("__set"))
        rows = rows.withColumn("__key", F.xxhash64(F.array_sort("__tokens")))
        out = rows.join(best, (rows["__key"] == best["__key"]) & (F.array_sort("__tokens") == F.col("__set")), "left").drop("__set")
    verdict = F.coalesce("__fit.verdict", "__best.v", F.lit(DEFAULT))
    return out.select(key, F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__fit.rule").alias("rule"), verdict.alias("verdict"), F.when(F.col("__fit").isNull(), F.col("__best.rule_id")).alias("mined_rule"))


def marked(host: Column) -> Column:
    """Does a host hold one of ``MARKS``?"""
    out = F.lit(False)
    for word in MARKS:
        out = out | host.contains(word)
    return out


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page.

    Pages are labelled ``block`` if their host holds one of ``MARKS``, else ``allow`` if the document of their number is of good quality and not toxic; the others have no
    label. The document labels of the test tables don't depend on URLs, so bad ones block nothing here.
    """
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    good = read(spark, sf_dir, "labels").where("quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").alias("page_id"), F.lit("allow").alias("verdict"))
    bad = pages.where(marked(split_url(F.col("url"))[0])).select("page_id", F.lit("block").alias("verdict"))
    return judge(pages, good.unionByName(bad)).drop("mined_rule")


def _sql() -> str:
    order = sorted(CURATED, key=lambda r: (-len(r[0] + r[1]), r[0]))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for h, p, v in order]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{r}'" for f, r, _ in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, _, v in fits) + " END"
    return f"""
WITH RECURSIVE u AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, url, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
j AS (SELECT p.*, {rule} AS rule, {verdict} AS given,
  list_distinct(list_concat(
    list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x),
    list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: 'p:' || CASE WHEN regexp_full_match(x, '[0-9]+([.][a-z]+)?') THEN '#' ELSE x END),
    list_transform(list_filter(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'), lambda x: x <> ''), lambda x: 'q:' || string_split(x, '=')[1]))) AS tokens FROM p),
l AS (SELECT page_id, max(v) AS verdict FROM (
  SELECT doc_id AS page_id, 'allow' AS v FROM labels WHERE quality = 1 AND coalesce(toxic, 0) = 0
  UNION ALL SELECT page_id, 'block' FROM p WHERE regexp_matches(host, '{"|".join(MARKS)}')) GROUP BY 1),
t AS (SELECT row_number() OVER () AS r, tokens, verdict FROM j JOIN l USING (page_id)),
total AS (SELECT count(*) AS n FROM t),
x AS (SELECT r, unnest(tokens) AS token FROM t),
same AS (SELECT token, list(r ORDER BY r) AS rs FROM x GROUP BY token HAVING count(*) >= {LEAST}),
stands AS (SELECT min(token) AS token FROM same GROUP BY rs),
few AS (SELECT r, verdict, list(token ORDER BY token) AS ts FROM (SELECT t.r, verdict, unnest(tokens) AS token FROM t) JOIN stands USING (token) GROUP BY r, verdict),
parts AS (SELECT r, verdict, ts, []::VARCHAR[] AS tokens, 0 AS pos FROM few
  UNION ALL SELECT r, verdict, ts, list_append(tokens, ts[i]), i FROM (SELECT *, unnest(range(pos + 1, len(ts) + 1)) AS i FROM parts)),
r0 AS (SELECT tokens, verdict, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY tokens) AS confidence, count(*) / (SELECT n FROM total) AS support FROM parts WHERE len(tokens) > 0 GROUP BY 1, 2),
r1 AS (SELECT * FROM r0 WHERE n >= ceil(greatest({SUPPORT}::DOUBLE * (SELECT n FROM total), {LEAST})) AND confidence >= {CONFIDENCE}),
rules AS (SELECT * FROM r1 a WHERE NOT EXISTS (SELECT 1 FROM r1 b WHERE len(b.tokens) < len(a.tokens) AND list_has_all(a.tokens, b.tokens) AND b.verdict = a.verdict AND b.confidence >= a.confidence)),
best AS (SELECT url, arg_max(rules.verdict, (confidence, support, rules.verdict, array_to_string(rules.tokens, ' '))) AS v
  FROM (SELECT DISTINCT url, tokens FROM j WHERE rule IS NULL) k JOIN rules ON list_has_all(k.tokens, rules.tokens) GROUP BY url)
SELECT page_id, host, path, rule, coalesce(given, v, '{DEFAULT}') AS verdict FROM j LEFT JOIN best USING (url)
"""


SQL_URL_FILTER = _sql()
