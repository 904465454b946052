"""Mixing sources to target weights by hierarchical budgeting.

A token budget flows down a tree (domain, language, source). At each node it is split among the children by weight; a
child that has too few tokens (counted over all allowed epochs) is filled and what it can't use goes to its siblings,
and only what a whole subtree can't use goes up to the siblings of its ancestors. Each leaf then takes a prefix, by
tokens, of its seeded epochs: whole epochs first, then the prefix of one more shuffle.

The split has a closed form (children sorted by capacity over weight), so it is two windows a level over the tree's
nodes; nothing is collected. Prefix sums within a leaf are dealt into as many hash ranges as its rows ask for, as a leaf may hold a third of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, read
from .sharding import fingerprints, occurrence, without

SEED = 8
#: Part of the corpus's tokens that op8 asks for, and epochs that a leaf may run through.
FRACTION = 0.6
MAX_EPOCHS = 2
#: Rows of a range of the shuffle key that one task adds up, about; a leaf has 16 ** n ranges, by its own size.
RANGE_ROWS = 4096
#: Leaves are broadcast up to so many (some 10 MB), which spares a shuffle by leaf; more are joined by a shuffle.
BROADCAST_LEAVES = 100_000
LEVELS = ("domain", "lang", "source")
#: Weights by path from the root; a node that isn't listed weighs 1.
WEIGHTS = {"d0": 4.0, "d1": 3.0, "d2": 2.0, "d3": 1.0} | {f"d{d}/{lang}": w for d in range(4) for lang, w in (("en", 3.0), ("de", 2.0), ("fr", 2.0), ("es", 1.0))}
WORD = r"[^\x09-\x0D\x20]+"


def domain_of(source: Column) -> Column:
    """The domain of a source: the last number in its name modulo 4; ``other`` without one."""
    number = F.regexp_extract(source.cast("string"), r"([0-9]{1,9})$", 1)
    return F.when(F.coalesce(number, F.lit("")) != "", F.concat(F.lit("d"), F.pmod(number.cast("long"), F.lit(4)).cast("string"))).otherwise("other")


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _path(n: int) -> Column:
    return F.concat_ws("/", *[f"__l{i}" for i in range(n)])


def _split(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Give each node (``__cap``, ``__w``) its share ``__give`` of its parent's budget ``__give_up``."""
    by = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    order = by.orderBy(F.expr("__cap / nullif(__w, 0)").asc_nulls_last(), "__p")
    nodes = nodes.withColumn("__rn", F.row_number().over(order))
    cap = F.when(F.col("__w") > 0, F.col("__cap")).otherwise(F.lit(0))
    before = F.sum(cap).over(order.rowsBetween(W.unboundedPreceding, 0)) - cap
    rest = F.sum("__w").over(order.rowsBetween(0, W.unboundedFollowing))
    nodes = nodes.withColumn("__level", F.when(rest > 0, (F.col("__give_up") - before) / rest))
    nodes = nodes.withColumn("__full", F.coalesce((F.col("__w") > 0) & (F.col("__cap") <= F.col("__level") * F.col("__w")), F.lit(False)))
    open_level = F.min(F.when(~F.col("__full"), F.struct("__rn", "__level"))).over(by)["__level"]
    give = F.when(F.col("__full"), F.col("__cap").cast("double")).otherwise(F.coalesce(open_level * F.col("__w"), F.lit(0.0)))
    return nodes.withColumn("__give", give).drop("__rn", "__level", "__full", "__give_up")


def budgets(leaves: DataFrame, levels: int, weights: dict[str, float], budget: float | None, fraction: float, max_epochs: int) -> DataFrame:
    """Leaves (``__l0`` .., ``__tokens``) with the tokens ``__give`` that each is to yield."""
    table = F.create_map(*[F.lit(x) for pair in sorted(weights.items()) for x in pair]) if weights else None
    weight = lambda n: F.coalesce(F.try_element_at(table, _path(n)), F.lit(1.0)) if weights else F.lit(1.0)
    tiers = {levels: leaves.withColumn("__cap", F.col("__tokens") * F.lit(max_epochs)).withColumn("__w", weight(levels)).withColumn("__p", _path(levels))}
    for n in range(levels - 1, 0, -1):
        names = [f"__l{i}" for i in range(n)]
        cap = F.sum(F.when(F.col("__w") > 0, F.col("__cap")).otherwise(F.lit(0))).alias("__cap")
        tiers[n] = tiers[n + 1].groupBy(*names).agg(cap).withColumn("__w", weight(n)).withColumn("__p", _path(n))
    asked = F.lit(float(budget)) if budget is not None else F.sum("__tokens").cast("double") * F.lit(fraction)
    total = leaves.agg(asked.alias("__want"))
    top = tiers[1].crossJoin(F.broadcast(total))  # one row
    most = F.sum(F.when(F.col("__w") > 0, F.col("__cap")).otherwise(F.lit(0))).over(W.partitionBy(F.lit(0)))
    out = _split(top.withColumn("__give_up", F.least("__want", most.cast("double"))).drop("__want"), [])
    for n in range(2, levels + 1):
        names = [f"__l{i}" for i in range(n - 1)]
        out = _split(tiers[n].join(out.select(*names, F.col("__give").alias("__give_up")), names), names)
    return out.drop("__cap", "__w", "__p")


def draw(light: DataFrame, levels: list[str], key: str, tokens: str, weights: dict[str, float], *, budget: float | None = None, fraction: float = 1.0, max_epochs: int = 1, seed: int = SEED) -> DataFrame:
    """The rows of ``light`` that the mixture takes, once for each epoch that takes them, with ``epoch`` (int, from 0).

    A row is taken in the last epoch if the tokens before it in that epoch's shuffle are fewer than what is still due,
    so a leaf passes its share by less than one row. Null level values make a node named ``~``. Rows without
    tokens in a leaf without tokens are never taken. An empty input gives an empty result; ids may repeat.
    """
    names = [f"__l{i}" for i in range(len(levels))]
    light = cut(light)  # three passes over light rows, one over texts
    rows = without(light, "epoch").withColumns({n: F.coalesce(F.col(c).cast("string"), F.lit("~")) for n, c in zip(names, levels, strict=True)})
    rows = rows.withColumn("__t", F.coalesce(F.col(tokens), F.lit(0)).cast("long"))
    leaves = cut(rows.groupBy(*names).agg(F.sum("__t").alias("__tokens"), F.count("*").alias("__rows")))
    due = budgets(leaves, len(levels), weights, budget, fraction, max_epochs)
    due = cut(due.where("__tokens > 0").withColumn("__e", F.floor(F.col("__give") / F.col("__tokens")).cast("int")).withColumn("__rest", F.expr("__give - __e * __tokens")))
    due = due.select(*names, "__e", "__rest", F.greatest(F.ceil(F.log(16.0, F.col("__rows") / RANGE_ROWS)), F.lit(0)).cast("int").alias("__digits"))
    rows = rows.join(F.broadcast(due) if due.count() <= BROADCAST_LEAVES else due, names)
    id_text = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    rows = rows.withColumn("__k", F.md5(F.concat(F.lit(f"{seed}:"), F.col("__e").cast("string"), F.lit(":"), id_text))).withColumn("__b", F.substr("__k", F.lit(1), F.col("__digits")))
    ties = [F.col(f"`{c}`") for c, kind in light.dtypes if not kind.startswith("map") and c.lower() != "epoch"]
    sums = rows.groupBy(*names, "__b").agg(F.sum("__t").alias("__c"))
    sums = sums.withColumn("__before", F.sum("__c").over(W.partitionBy(*names).orderBy("__b")) - F.col("__c")).drop("__c")
    rows = rows.join(sums, [*names, "__b"])
    mine = W.partitionBy(*names, "__b").orderBy("__k", *ties).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("__sum", F.col("__before") + F.sum("__t").over(mine) - F.col("__t"))
    epochs = F.col("__e") + F.when(F.col("__sum") < F.col("__rest"), 1).otherwise(0)
    rows = rows.withColumn("__n", epochs).where("__n > 0")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    return rows.drop(*names, "__t", "__e", "__rest", "__digits", "__k", "__b", "__before", "__sum", "__n")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    light = read(spark, sf_dir, "documents").select("doc_id", domain_of(F.col("source")).alias("domain"), "lang", "source", tokens_of(F.col("text")).alias("n_tokens"))
    return draw(light, list(LEVELS), "doc_id", "n_tokens", WEIGHTS, fraction=FRACTION, max_epochs=MAX_EPOCHS)


def mix_documents(docs: DataFrame, *, fraction: float, max_epochs: int, weights: dict[str, float] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """Documents (all their columns) drawn to the mixture; the text travels once, in the join that brings the choice back."""
    rows, order = fingerprints(docs), ["source", "lang", "__crc", "__size"]
    light = occurrence(rows.select("doc_id", *order, tokens_of(F.col("text")).alias("n_tokens")), "doc_id", *order)
    light = light.select("doc_id", F.col("__occ").alias("occ"), domain_of(F.col("source")).alias("domain"), "lang", "source", "n_tokens")
    taken = draw(light, list(LEVELS), "doc_id", "n_tokens", weights, fraction=fraction, max_epochs=max_epochs, seed=seed)
    taken = taken.select(F.col("doc_id").alias("__id"), F.col("occ").alias("__o"))
    full = occurrence(rows, "doc_id", *order)
    return full.join(taken, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__occ") == F.col("__o"))).select(*[full[f"`{c}`"] for c in docs.columns])


def _sql_split(name: str, source: str, parent: str) -> str:
    by = f"PARTITION BY {parent}" if parent else ""
    order = f"{by} ORDER BY cap / nullif(w, 0) NULLS LAST, p"
    return f"""
{name}_a AS (SELECT *, row_number() OVER ({order}) AS rn,
    sum(CASE WHEN w > 0 THEN cap ELSE 0 END) OVER ({order} ROWS UNBOUNDED PRECEDING) - CASE WHEN w > 0 THEN cap ELSE 0 END AS before,
    sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM {source}),
{name}_b AS (SELECT *, CASE WHEN rest > 0 THEN (give_up - before) / rest END AS lvl FROM {name}_a),
{name}_c AS (SELECT *, coalesce(w > 0 AND cap <= lvl * w, false) AS is_full FROM {name}_b),
{name} AS (SELECT *, CASE WHEN is_full THEN cap::DOUBLE ELSE coalesce((arg_min(lvl, rn) FILTER (NOT is_full) OVER ({by})) * w, 0) END AS give FROM {name}_c)"""


_VALUES = ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in sorted(WEIGHTS.items()))
SQL_MIXING = f"""
WITH weights(p, w) AS (VALUES {_VALUES}),
light AS (
  SELECT doc_id, source, lang, CASE WHEN regexp_extract(source, '([0-9]{{1,9}})$', 1) <> '' THEN 'd' || (regexp_extract(source, '([0-9]{{1,9}})$', 1)::BIGINT % 4) ELSE 'other' END AS domain,
    len(regexp_extract_all(text, '[^\\x09-\\x0D\\x20]+'))::BIGINT AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM light GROUP BY ALL),
l3 AS (SELECT leaf.*, (tokens * {MAX_EPOCHS})::DOUBLE AS cap, coalesce(w, 1) AS w, domain || '/' || lang || '/' || source AS p FROM leaf LEFT JOIN weights ON p = domain || '/' || lang || '/' || source),
l2 AS (SELECT x.*, coalesce(weights.w, 1) AS w FROM (SELECT domain, lang, sum(cap) AS cap, domain || '/' || lang AS p FROM l3 GROUP BY ALL) x LEFT JOIN weights USING (p)),
l1 AS (SELECT x.*, coalesce(weights.w, 1) AS w FROM (SELECT domain, sum(cap) AS cap, domain AS p FROM l2 GROUP BY ALL) x LEFT JOIN weights USING (p)),
n1 AS (SELECT *, least((SELECT sum(tokens)::DOUBLE * {FRACTION}::DOUBLE FROM leaf), sum(cap) OVER ()) AS give_up FROM l1),
{_sql_split("g1", "n1", "")},
n2 AS (SELECT l2.*, g1.give AS give_up FROM l2 JOIN g1 USING (domain)),
{_sql_split("g2", "n2", "domain")},
n3 AS (SELECT l3.*, g2.give AS give_up FROM l3 JOIN g2 USING (domain, lang)),
{_sql_split("g3", "n3", "domain, lang")},
due AS (SELECT domain, lang, source, floor(give / tokens)::INTEGER AS e, give - floor(give / tokens) * tokens AS rest FROM g3 WHERE tokens > 0),
keyed AS (SELECT light.*, e, rest, md5('{SEED}:' || e || ':' || doc_id) AS k FROM light JOIN due USING (domain, lang, source)),
summed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) - n_tokens AS before FROM keyed)
SELECT doc_id, domain, lang, source, n_tokens, unnest(range(e + CASE WHEN before < rest THEN 1 ELSE 0 END))::INTEGER AS epoch FROM summed
"""
