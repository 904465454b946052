"""Benchmark decontamination by a distributed positional inverted index.

All training tokens that occur in the benchmark are counted; the index then keeps a posting (term, document, position) for every
token that is among the two rarest of a phrase, as others are never looked up. The rarest term's postings, shifted by its
offset, are a phrase's candidate starts; they are intersected with the shifted postings of the second rarest, and what is left is
compared word by word. DataFrame operations only.

A row is keyed by its id and a hash of its text, so repeated ids stay apart. Frequent terms are never looked up,
unless a phrase has no rarer one; no group grows beyond the words of one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, free_name, lower_ascii, read, release, store

WINDOW = 8
#: Items that a document must share windows with to count as contaminated.
ITEMS = 2
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A table of test terms or phrases is broadcast up to so many rows and characters; a larger one is joined by a shuffle.
BROADCAST_ROWS, BROADCAST_CHARS = 200_000, 20_000_000


def words_of(text: Column) -> Column:
    """Words: runs of digits, letters (A-Z lower-cased) and non-ASCII characters; a null text has none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def fits(df: DataFrame) -> bool:
    """Is a table small enough to be broadcast, by its rows and the characters of all its columns?"""
    chars = sum((F.length(F.concat_ws(" ", c)) if kind in ("string", "array<string>") else F.lit(8) for c, kind in df.dtypes), F.lit(0))
    size = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(chars), F.lit(0)).alias("c")).first()
    return size["n"] <= BROADCAST_ROWS and size["c"] <= BROADCAST_CHARS


def maybe_broadcast(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(wid, win array, items array of ids as strings): the distinct windows of ``size`` words of (item_id, text) rows.

    An item of fewer words, but not none, is one window.
    """
    w = items.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    w = w.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("win"))
    return w.groupBy("win").agg(F.collect_set("item").alias("items")).select(F.md5(F.concat_ws(" ", "win")).alias("wid"), "win", "items")


def postings(docs: DataFrame, terms: DataFrame, small: bool) -> DataFrame:
    """The index: (term, doc_id, text_key, pos from 0) for every token of (doc_id, text) rows that is in ``terms``."""
    tokens = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), F.posexplode(words_of(F.col("text"))).alias("pos", "term"))
    return tokens.join(maybe_broadcast(terms, small), "term", "left_semi").select("term", "doc_id", "text_key", "pos")


def _same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])


def frequencies(docs: DataFrame, terms: DataFrame, small: bool) -> DataFrame:
    """(term, n): how often each of ``terms`` occurs; those that don't are left out."""
    tokens = docs.select(F.explode(words_of(F.col("text"))).alias("term"))
    return tokens.join(maybe_broadcast(terms, small), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))


def rarest_terms(phrases: DataFrame, frequency: DataFrame) -> DataFrame:
    """(wid, term, o1, term2, o2): the two rarest terms of (wid, win) phrases and their offsets; phrases with a term that never occurs are left out."""
    terms = phrases.select("wid", F.size("win").alias("length"), F.posexplode("win").alias("offset", "term")).join(frequency, "term")
    ranked = terms.groupBy("wid", "length").agg(F.array_sort(F.collect_list(F.struct("n", "term", "offset"))).alias("t")).where(F.size("t") == F.col("length"))
    second = F.try_element_at("t", F.lit(2))
    return ranked.select("wid", F.col("t")[0]["term"].alias("term"), F.col("t")[0]["offset"].alias("o1"), second["term"].alias("term2"), second["offset"].alias("o2"))


def exact_matches(index: DataFrame, ranked: DataFrame, small: bool) -> DataFrame:
    """Candidate starts (doc_id, text_key, wid, start) of the phrases of :func:`rarest_terms`: both rarest terms stand where they should.

    A phrase of one term is matched by that term alone.
    """
    first = index.join(maybe_broadcast(ranked, small), "term").where("pos >= o1")
    first = first.select("doc_id", "text_key", "wid", F.expr("pos - o1").alias("start"), "term2", F.expr("pos - o1 + o2").alias("pos2"))
    seconds = ranked.select(F.col("term2").alias("term")).where("term is not null").distinct()
    second = index.join(maybe_broadcast(seconds, small), "term", "left_semi").distinct()
    on = _same_row(first, second) & (first["term2"] == second["term"]) & (first["pos2"] == second["pos"])
    both = first.where("term2 is not null").join(second, on, "left_semi").select("doc_id", "text_key", "wid", "start")
    return both.union(first.where("term2 is null").select("doc_id", "text_key", "wid", "start"))


def proximity_matches(index: DataFrame, queries: DataFrame, span: int) -> DataFrame:
    """(query_id, doc_id, text_key, start): all distinct terms of (query_id, terms array) stand within ``span`` positions from start.

    ``start`` is the position of one of the terms. Postings meet by blocks of ``span`` positions within a document, and only
    in documents that hold the query's rarest term.
    """
    frequency = index.groupBy("term").agg(F.count("*").alias("n"))
    terms = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term")).join(frequency, "term", "left")
    whole = terms.groupBy("query_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term")).alias("m"), F.count("*").alias("k"))
    terms = terms.join(whole.where("m.n > 0"), "query_id")
    hits = index.join(terms.select("query_id", "term", "k", F.col("m.term").alias("rarest")), "term")
    rows = hits.where("term = rarest").select(F.col("query_id").alias("q"), F.col("doc_id").alias("d"), F.col("text_key").alias("t")).distinct()
    same = F.col("query_id").eqNullSafe(F.col("q")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t"))
    hits = cut(hits.join(rows, same, "left_semi").select("query_id", "doc_id", "text_key", "k", "term", "pos", F.expr(f"pos div {span}").alias("block")))
    start = hits.select(F.col("query_id").alias("q"), F.col("doc_id").alias("d"), F.col("text_key").alias("t"), F.col("pos").alias("start"), F.explode(F.array("block", F.col("block") + 1)).alias("b")).distinct()
    near = hits.join(start, same & (F.col("block") == F.col("b")) & F.col("pos").between(F.col("start"), F.col("start") + span - 1))
    return near.groupBy("query_id", "doc_id", "text_key", "k", "start").agg(F.count_distinct("term").alias("found")).where("found = k").drop("k", "found")


def flag(docs: DataFrame, items: DataFrame, size: int = WINDOW, min_items: int = ITEMS) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` (doc_id, text and any other columns) with four columns more, and their names: ``n_words``, ``n_hit``, ``items`` and ``contaminated``. Names that ``docs`` has already are avoided."""
    phrases = cut(windows(items, size))
    terms = cut(phrases.select(F.explode("win").alias("term")).distinct())
    frequency = cut(frequencies(docs, terms, fits(terms)))
    ranked = cut(rarest_terms(phrases, frequency))
    looked_up = cut(ranked.select("term").union(ranked.select("term2")).where("term is not null").distinct())
    release(docs.sparkSession)
    index = store(postings(docs, looked_up, fits(looked_up)), "postings")
    found = exact_matches(index, ranked, fits(ranked)).join(maybe_broadcast(phrases, fits(phrases)), "wid")
    name = {c: free_name(docs, c) for c in ("id", "key", "k", "found", "w", "hits", "n_words", "n_hit", "items", "contaminated")}
    found = found.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "win", "items")).alias(name["found"]))  # of one text
    found = found.select(F.col("doc_id").alias(name["id"]), F.col("text_key").alias(name["key"]), name["found"])
    rows = docs.withColumn(name["k"], text_key(F.col("text"))).withColumn(name["n_words"], F.size(words_of(F.col("text"))).cast("long"))
    rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col(name["id"])) & (F.col(name["k"]) == F.col(name["key"])), "left").drop(name["id"], name["key"], name["k"])
    rows = rows.withColumn(name["w"], F.when(F.col(name["found"]).isNotNull(), words_of(F.col("text"))))
    rows = rows.withColumn(name["hits"], F.filter(name["found"], lambda c: F.slice(F.col(name["w"]), c["start"] + 1, F.size(c["win"])) == c["win"]))
    inside = F.array_distinct(F.flatten(F.transform(name["hits"], lambda h: F.sequence(h["start"], h["start"] + F.size(h["win"]) - 1))))
    rows = rows.withColumn(name["n_hit"], F.when(F.col(name["found"]).isNull(), F.lit(0)).otherwise(F.size(inside)).cast("long"))
    all_items = F.array_sort(F.array_distinct(F.flatten(F.transform(name["hits"], lambda h: h["items"]))))
    rows = rows.withColumn(name["items"], F.coalesce(all_items, F.array().cast("array<string>")))
    return rows.withColumn(name["contaminated"], F.size(name["items"]) >= min_items).drop(name["found"], name["hits"], name["w"]), name


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW, min_items: int = ITEMS) -> DataFrame:
    """One row a document: doc_id, text, n_words, n_hit (words inside any occurrence of a window), items (sorted ids), contaminated.

    Null and empty texts have no words and no hits; an empty benchmark marks nothing; repeated rows each get their row.
    """
    rows, name = flag(docs.select("doc_id", "text"), items, size, min_items)
    return rows.select("doc_id", "text", *[F.col(name[c]).alias(c) for c in ("n_words", "n_hit", "items", "contaminated")])


def clean_documents(docs: DataFrame, items: DataFrame, min_items: int = 1, size: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` (all columns) that share windows with fewer than ``min_items`` items; those of null or empty texts among them."""
    rows, name = flag(docs, items, size, min_items)
    return rows.where(~F.col(name["contaminated"])).select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"), "contaminated")


_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
SQL_DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[i:i + {WINDOW - 1}] AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(g) AS n FROM win),
grams AS (SELECT doc_id, n, i, w[i:i + n - 1] AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
occ AS (SELECT doc_id, item_id, i, n FROM grams JOIN win USING (g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM occ)) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM occ GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= {ITEMS} AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
