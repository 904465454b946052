import numpy as np
import pytest
from pyspark.sql import functions as F

from sastra.llm import language_id as L
from sastra.llm import toxicity as T
from sastra.llm.common import FOLD, LETTERS, NOT_SPACE, Words

WORDS = {"en": "the and house river stone water with from", "de": "und der haus fluss stein wasser mit von", "fr": "et le maison fleuve pierre eau avec chez"}


def text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang].split(), n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(300):
        lang = list(WORDS)[i % 3]
        t = text(rng, lang, int(rng.integers(5, 60)))
        if i % 4 == 1:
            t += " foulword " + text(rng, lang, 4)
        rows.append((i, t, lang, "s", len(t)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, int(i % 4 == 1)) for i in range(300)] + [(5, 1, None), (None, 1, 1), (9999, 0, 1)], "doc_id long, quality int, toxic int")


ODD = [(1000, None), (1001, ""), (1002, "123 !!"), (1003, "the " * 50_000), (1004, "ü"), (None, "the house"), (1000, None)]


def test_word_hashes_do_not_depend_on_place():
    a, b = Words([b"x Foo bar", b"", b"bar foo"], LETTERS, FOLD), Words([b"foo bar"], NOT_SPACE, FOLD)
    h, g = a.hashes(), b.hashes()
    assert list(a.first) == [0, 3, 3, 5] and h[1] == h[4] == g[0] and h[2] == h[3] == g[1] and len(set(h.tolist())) == 3


def test_language(spark, docs):
    model = L.fit(docs)
    assert model.languages == ["de", "en", "fr"]
    got = L.add_language(docs, model)
    assert got.where("lang = lang_pred").count() == 300 and got.where("score < 0 or score > 1").count() == 0
    odd = spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("*", "'zz' AS lang_pred", "1 AS SCORE", "7 AS __low")
    rows = [(r["doc_id"], r["lang_pred"], r["score"]) for r in L.add_language(odd, model).collect()]
    assert {r["__low"] for r in L.add_language(odd, model).collect()} == {7}
    assert [r[1] for r in rows][:3] == ["und"] * 3 and rows[3][1] == "en" and rows[4][1] in model.languages and rows[5][1] == "en"
    assert L.add_language(odd.limit(0), model).count() == 0


def test_rare_languages_stay_in_the_sample(spark):
    sizes = {f"l{k}": 700 if k < 12 else 20 for k in range(16)}
    rows = [(i, "some text", lang) for i, lang in enumerate(x for x, n in sizes.items() for _ in range(n))]
    got = L.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), lambda i: i >= 0).groupBy("lang").count().collect()
    counts = {r["lang"]: r["count"] for r in got}
    assert sum(counts.values()) == L.SAMPLE_TOTAL and all(counts[f"l{k}"] == 20 for k in range(12, 16))
    large = [counts[f"l{k}"] for k in range(12)]
    assert max(large) - min(large) <= 1


def test_code_switching(spark, docs):
    model = L.fit(docs)
    marked = [lang for _, lang, _ in L.switches(model, "the house river water und der fluss stein wasser")]
    assert marked == ["en"] * 4 + ["de"] * 5
    stay = np.diag(model.transitions).min()
    assert stay > (model.transitions - np.diag(np.diag(model.transitions))).max()


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    scores, begin, moves = rng.normal(size=(5, 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    total, mass = 0.0, np.zeros((5, 3))
    for path in np.ndindex(3, 3, 3, 3, 3):
        w = np.exp(begin[path[0]] + sum(scores[t, k] for t, k in enumerate(path)) + sum(moves[a, b] for a, b in zip(path[:-1], path[1:], strict=True)))
        total += w
        for t, k in enumerate(path):
            mass[t, k] += w
    assert np.allclose(L.forward_backward(scores, np.array([0, 5]), begin, moves), mass / total)


def test_no_training_rows(spark, docs, labels):
    none = docs.withColumn("lang", docs["source"].cast("string").substr(5, 1))
    assert {r["lang_pred"] for r in L.add_language(docs.limit(5), L.fit(docs.limit(0))).collect()} == {"und"}
    assert L.fit(none.where("lang <> ''")).languages == []
    odd = docs.limit(5).select("doc_id", "text").union(spark.createDataFrame([(1, ""), (2, None), (3, "one two three")], "doc_id long, text string"))
    for known, want in ((labels.limit(0), lambda s: s == 0.25), (labels.where("toxic = 0"), lambda s: s < 0.01), (labels.where("toxic = 1"), lambda s: s > 0.9)):
        scores = {r["score"] for r in T.add_scores(odd, T.fit(docs, known)).collect()}
        assert len(scores) == 1 and want(scores.pop())


def test_scores_do_not_depend_on_company(docs, labels):
    model = T.fit(docs, labels)
    texts = [(r["text"] or "").encode() for r in docs.select("text").limit(60).collect()] + [b"", b"a", ("the " * 30_000).encode()]
    together = T.scores(model, *T.buckets_of(texts))
    assert [T.scores(model, *T.buckets_of([t]))[0] for t in texts] == together.tolist()
    assert T.scores(model, *T.buckets_of(texts[::-1])).tolist() == together.tolist()[::-1]


def plain_score(model, text):
    """A text's score word by word: lengths of filters, maxima and the logistic layer, without arrays of words."""
    ids, _ = T.buckets_of([text])
    pad = [T.BUCKETS, T.BUCKETS]
    z = model.out_bias
    for k, width in enumerate(T.WIDTHS):
        if len(ids):
            best = [max(sum((np.float32(model.tables[k][o][w][f]) for o in range(width) for w in (list(ids[i + o]) if i + o < len(ids) else pad)), np.float32(0)) for i in range(len(ids))) for f in range(T.FILTERS)]
            z += sum(max(float(b + model.bias[k][f]), 0) * float(model.out[k][f]) for f, b in enumerate(best))
    guess = int(np.argmax(sum((model.profile[w[0]].astype(float) for w in ids), np.zeros(model.profile.shape[1]))))
    return 1 / (1 + np.exp(-(z - model.cutoff[guess])))


def test_scores_like_brute_force(spark, docs, labels):
    model = T.fit(docs, labels)
    rows = docs.select("doc_id", "text").limit(12).union(spark.createDataFrame([(1, ""), (2, "foulword"), (3, "the foulword")], "doc_id long, text string"))
    for r in T.add_scores(rows, model).collect():
        assert abs(r["score"] - plain_score(model, r["text"].encode())) < 1e-5


def test_long_texts_are_drawn(spark, monkeypatch):
    rows = [(i, "word " * (30_000 if i % 2 else 3), "en") for i in range(40)]
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    got = T.sample(df, marks, lambda i: i >= 0).to_pandas()
    assert sorted(got["doc_id"]) == list(range(40)) and {len(x) // 4 for x in got["ids"]} == {3, 30_000}
    monkeypatch.setattr(T, "SAMPLE_CHARS", 400_000)
    assert T.sample(df, marks, lambda i: i >= 0).to_pandas().groupby("toxic").size().to_dict() == {0: 20, 1: 3}
    names = df.withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "xx").otherwise("en"))
    assert L.sample(names, lambda i: i >= 0).select("lang").distinct().count() == 2


def test_language_like_brute_force(spark, docs):
    model = L.fit(docs)
    rng = np.random.default_rng(3)
    odd = [f"{text(rng, 'en', 2)} {text(rng, 'de', 3)}", text(rng, "fr", 1), "x", "the und et", "Haus 7 river!"]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.add_language(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(odd):
        words = Words([t.lower().encode()], LETTERS, np.arange(256, dtype=np.uint8))
        ids, first = L.features(words, np.arange(len(words)), model.lexicon)
        scores = [sum(model.weights[b].astype(float) for b in ids[a:z]) / np.sqrt(z - a) for a, z in zip(first[:-1], first[1:], strict=True)]
        mass = np.zeros(3)
        for path in np.ndindex(*[3] * len(scores)):  # every labelling of the words
            w = np.exp(model.begin[path[0]] + sum(s[k] for s, k in zip(scores, path, strict=True)) + sum(model.transitions[a, b] for a, b in zip(path[:-1], path[1:], strict=True)))
            mass += w * np.bincount(path, minlength=3) / len(path)
        mass /= mass.sum()
        assert got[i][0] == model.languages[mass.argmax()] and abs(got[i][1] - mass.max()) < 1e-4


def test_toxicity(spark, docs, labels):
    model = T.fit(docs, labels)
    rows = T.add_scores(docs, model).collect()
    held = [r for r in rows if __import__("zlib").crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert sum((r["score"] >= 0.5) == (r["doc_id"] % 4 == 1) for r in held) >= 0.95 * len(held)
    odd = spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS ids")
    got = T.add_scores(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got) and got[0]["score"] == got[1]["score"] == got[2]["score"] == got[6]["score"]
    assert T.add_scores(odd.limit(0), model).count() == 0


def test_training_repeats(docs, labels):
    a, b = T.fit(docs, labels), T.fit(docs, labels)
    assert np.array_equal(a.out, b.out) and np.array_equal(a.cutoff, b.cutoff)
