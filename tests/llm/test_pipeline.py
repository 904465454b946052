
import random

import corpus_pipeline as P
from sastra.llm import decontamination, near_dedup, toxicity
from sastra.llm.common import read

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read(spark, DATA, "documents")
    columns = docs.columns
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    model = toxicity.fit(docs, read(spark, DATA, "labels"))
    want = {r["doc_id"] for r in toxicity.add_scores(docs, model).where("score < 0.5").collect()}
    docs = P.toxic(spark, docs, DATA).cache()
    assert docs.columns == columns and {r["doc_id"] for r in docs.collect()} == want
    smallest = {r["doc_id"] for r in near_dedup.near_duplicates(docs.select("doc_id", "text")).where("doc_id = component_id").collect()}
    docs = P.near_duplicates(spark, docs, DATA).cache()
    assert docs.columns == columns and {r["doc_id"] for r in docs.collect()} == smallest
    clean = {r["doc_id"] for r in decontamination.decontaminate(docs, read(spark, DATA, "benchmark")).where("n_hit = 0").collect()}
    docs = P.benchmark_leaks(spark, docs, DATA).cache()
    assert docs.columns == columns and {r["doc_id"] for r in docs.collect()} == clean
    mixed = P.mixture(spark, docs, DATA).cache()
    assert mixed.columns == columns and mixed.select("doc_id").distinct().count() == mixed.count() and 0 < mixed.count() <= docs.count()
    last = P.shards(spark, mixed, DATA)
    assert last.count() == mixed.count() and last.select("shard", "slot").distinct().count() == mixed.count()


def test_empty(spark):
    docs = read(spark, DATA, "documents").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, DATA)
        assert docs.count() == 0


def test_far_ids_and_odd_rows(spark):
    """Ids too large for nodes of two rules, nulls in any column, repeated rows, and columns named like those inside."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1 << 62, text, "en", "src0", 1), ((1 << 62) + 5, text + " x", None, None, None), (-7, "other words here", "en", "src1", 2), (None, None, None, None, None), (3, None, "de", "src0", 0), (3, None, "de", "src0", 0), (4, "", "de", "src0", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for shift, kept in ((0, [-7, 0, 3, 4, 1 << 62]), (1 << 62, [-7, 0, 0, 3, 4])):
        docs = spark.createDataFrame([(i if i is None or i < 100 else i - shift, *r) for i, *r in rows], schema).selectExpr("*", "1 AS __n", "2 AS __hits", "3 AS shard_", "4 AS comp")
        got = P.near_duplicates(spark, docs, "")
        assert got.columns == docs.columns and sorted((r["doc_id"] or 0) for r in got.collect()) == sorted(kept)
        clean = P.benchmark_leaks(spark, got, DATA)
        assert clean.columns == docs.columns and clean.count() == got.count() and {r["__hits"] for r in clean.collect()} == {2}
        mixed = P.mixture(spark, clean, DATA)
        assert mixed.columns == docs.columns
        assert P.shards(spark, mixed, DATA).count() == mixed.count()


def test_near_duplicates_like_brute_force(spark):
    rng = random.Random(2)
    some = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]
    texts = []
    for n in (200, 300, 500):
        base = some(n)
        edited = list(base)
        for i in rng.sample(range(n), n * 24 // 1000):
            edited[i] = some(1)[0]
        # copies with text added or cut off, from 5 to 40 %; words replaced here and there; and a copy of an edited copy
        texts += [base, edited, edited + some(n // 5), *(base + some(n * k // 100) for k in (5, 20, 24, 40)), *(base[: n * k // 100] for k in (95, 82, 60))]
    texts += [some(n) for n in (1, 3, 4, 5, 60)]
    rng.shuffle(texts)
    cuts = lambda t, k: {tuple(t[i : i + k]) for i in range(max(len(t) - k + 1, 1))}
    sets = [{k: cuts(t, k) for k in (3, 5)} for t in texts]
    group = list(range(len(texts)))
    linked = {3: set(), 5: set()}
    for a, x in enumerate(sets):
        for b in range(a):
            for percent, k in ((85, 3), (80, 5)):
                y = sets[b]
                if 100 * len(x[k] & y[k]) >= percent * len(x[k] | y[k]):
                    linked[k].add((b, a))
                    group = [min(group[a], group[b]) if g in (group[a], group[b]) else g for g in group]
    assert linked[5] - linked[3] and linked[3] - linked[5]
    docs = spark.createDataFrame([(i, " ".join(t), "en", "src0", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r["doc_id"] for r in P.near_duplicates(spark, docs, "").collect())
    assert got == sorted(set(group))
