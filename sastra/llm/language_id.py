"""Language identification by a linear-chain conditional random field over the words of a text.

Each word gets scores for every language from hashed affix, character n-gram and lexicon features; a learned matrix of
transitions ties neighbours together, and forward-backward gives each word's posterior, so text that switches languages is
labelled word by word. A text's language is the one with most posterior mass.

Weights are fitted in numpy with AdaGrad on a bounded sample: runs of words of single documents, and runs spliced from documents
of different languages, whose seams teach the transitions. Executors hold the weights (2 MB, broadcast) and a few
megabytes of text at a time. Texts of a batch advance together, so the chain costs one vector step a word position.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import IDENTITY, LETTERS, Words, crc_of_id, fetch, free_name, read, slices, small_batches

BUCKETS = 1 << 16
AFFIXES, NGRAMS = (1, 2, 3, 4), (2, 3)
#: Documents of each language that the model is fitted on (about as many, by a hash of the id), the most in all, and the characters of
#: all of them: every language has the same part of those, and its last document may pass it. No text is left out for its length.
SAMPLE_DOCS, SAMPLE_TOTAL, SAMPLE_CHARS = 500, 4000, 40_000_000
#: Words in a training run, runs in all, the part that is spliced, passes, runs in a step, step size, least count of a lexicon word.
RUN, RUNS, SPLICED, EPOCHS, BATCH, RATE, LEXICON_COUNT, SEED = 40, 6000, 0.4, 3, 100, 0.3, 3, 2
#: Bytes of text that advance together.
BYTES = 4_000_000
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (BUCKETS, languages)
    lexicon: np.ndarray  # sorted word hashes
    begin: np.ndarray
    transitions: np.ndarray


def features(words: Words, pick: np.ndarray, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of the words ``pick``, and where each word's run of features begins."""
    sums = words.sums()
    start, end = words.start[pick], words.end[pick]
    parts, owner = [], []
    number = np.arange(len(pick))

    def add(h: np.ndarray, who: np.ndarray, kind: int) -> None:
        parts.append(((h * np.uint64(2 * kind + 0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int32))
        owner.append(who)

    for n in AFFIXES:
        long = end - start >= n
        add(words.spans(sums, start[long], start[long] + n), number[long], n)
        add(words.spans(sums, end[long] - n, end[long]), number[long], 16 + n)
    length = end - start
    for n in NGRAMS:
        count = np.maximum(length - n + 1, 0)
        who = np.repeat(number, count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + start[who]
        add(words.spans(sums, at, at + n), who, 32 + n)
    whole = words.spans(sums, start, end)
    known = lexicon[np.minimum(np.searchsorted(lexicon, whole), len(lexicon) - 1)] == whole if len(lexicon) else np.zeros(len(whole), bool)
    add(np.where(known, whole, np.uint64(1)), number, 64)  # words out of the lexicon share a feature
    owner_all, ids = np.concatenate(owner), np.concatenate(parts)
    order = np.argsort(owner_all, kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(owner_all, minlength=len(pick)))])
    return ids[order], first


def _word_scores(weights: np.ndarray, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(weights[ids], first[:-1], axis=0) / np.sqrt(np.diff(first))[:, None] if len(first) > 1 else np.zeros((0, weights.shape[1]))


def forward_backward(scores: np.ndarray, first: np.ndarray, begin: np.ndarray, transitions: np.ndarray, pairs: bool = False):
    """Posteriors (words, languages) of chains ``first[i]:first[i + 1]``; with ``pairs`` also expected transition counts and starts."""
    post = np.exp(scores - scores.max(axis=1, keepdims=True)) if len(scores) else scores.copy()
    evidence, alpha = post, np.empty_like(post)
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    at, length = first[:-1][order], length[order]
    active = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), "right")
    go, back = np.exp(transitions), np.exp(transitions).T.copy()
    x = np.empty((0, 0))
    for t, a in enumerate(active):
        x = (x[:a] @ go if t else np.exp(begin)[None]) * evidence[at[:a] + t]
        x /= x.sum(axis=1, keepdims=True)
        alpha[at[:a] + t] = x
    beta = np.ones((len(length), scores.shape[1]))
    out, counts = np.empty_like(alpha), np.zeros_like(transitions)
    for t in range(len(active) - 1, -1, -1):
        a = active[t]
        where = at[:a] + t
        p = alpha[where] * beta[:a]
        p /= p.sum(axis=1, keepdims=True)
        out[where] = p
        if t:
            message = evidence[where] * beta[:a]
            if pairs:
                joint = alpha[where - 1][:, :, None] * go[None] * message[:, None, :]
                counts += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            y = message @ back
            beta[:a] = y / y.sum(axis=1, keepdims=True)
    return (out, counts, out[first[:-1][np.diff(first) > 0]].sum(axis=0)) if pairs else out


def _runs(sequences: list[np.ndarray], labels: np.ndarray, rng) -> tuple[np.ndarray, np.ndarray]:
    """Training runs: word numbers and language numbers, (runs, RUN)."""
    by = [[s for s, k in zip(sequences, labels, strict=True) if k == lang and len(s) >= 4] for lang in range(labels.max() + 1)]
    able = [k for k, group in enumerate(by) if group]

    def take(n: int) -> tuple[np.ndarray, int]:
        k = able[rng.integers(len(able))]
        s = by[k][rng.integers(len(by[k]))]
        at = rng.integers(max(1, len(s) - n + 1))
        return np.resize(s[at : at + n], n), k

    words, langs = np.empty((RUNS, RUN), np.int64), np.empty((RUNS, RUN), np.int64)
    for i in range(RUNS):
        cuts = sorted(rng.choice(np.arange(4, RUN - 3), rng.integers(1, 3), replace=False)) if rng.random() < SPLICED else []
        for a, b in zip([0, *cuts], [*cuts, RUN], strict=True):
            words[i, a:b], langs[i, a:b] = take(b - a)
    return words, langs


def train(texts: list[bytes], langs: list[str]) -> Model:
    """Fit on whole texts (lower-cased UTF-8) and the names of their languages."""
    names = sorted(set(langs))
    n = len(names)
    empty = Model(names, np.zeros((BUCKETS, max(n, 1)), np.float32), np.zeros(0, np.uint64), np.zeros(max(n, 1)), np.zeros((max(n, 1),) * 2))
    if n < 2:
        return empty
    words = Words(texts, LETTERS, IDENTITY)
    distinct, where, word, counts = np.unique(words.hashes(), return_index=True, return_inverse=True, return_counts=True)
    lexicon = distinct[counts >= LEXICON_COUNT]
    ids, first = features(words, where, lexicon)
    sequences = [word[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
    if not any(len(s) >= 4 for s in sequences):
        return empty
    rng = np.random.default_rng(SEED)
    runs, labels = _runs(sequences, np.array([names.index(x) for x in langs]), rng)
    weights, begin, transitions = np.zeros((BUCKETS, n)), np.zeros(n), np.zeros((n, n))
    sums = [np.full(x.shape, 1e-3) for x in (weights, begin, transitions)]
    for _ in range(EPOCHS):
        order = rng.permutation(RUNS)
        for b in range(0, RUNS, BATCH):
            w, y = runs[order[b : b + BATCH]], labels[order[b : b + BATCH]]
            used, back = np.unique(w, return_inverse=True)
            count = first[used + 1] - first[used]
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[used], count)
            mine, mine_first = ids[at], np.concatenate([[0], np.cumsum(count)])
            scores = _word_scores(weights, mine, mine_first)[back.ravel()]
            chain = np.arange(0, w.size + 1, RUN)
            post, moves, starts = forward_backward(scores, chain, begin, transitions, pairs=True)
            truth = np.eye(n)[y.ravel()]
            by_word = np.zeros((len(used), n))
            np.add.at(by_word, back.ravel(), truth - post)
            by_word = np.repeat(by_word / np.sqrt(count)[:, None], count, axis=0)
            grad = np.stack([np.bincount(mine, weights=by_word[:, k], minlength=BUCKETS) for k in range(n)], axis=1) / w.size
            real = np.zeros((n, n))
            np.add.at(real, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
            for value, total, g in zip((weights, begin, transitions), sums, (grad - 1e-7 * weights, (np.bincount(y[:, 0], minlength=n) - starts) / w.size, (real - moves) / w.size), strict=True):
                total += g * g
                value += RATE * g / np.sqrt(total)
    return Model(names, weights.astype(np.float32), lexicon, begin, transitions)


def label(model: Model, texts: list[bytes]) -> tuple[Words, np.ndarray]:
    """The words of lower-cased texts and their posteriors."""
    words = Words(texts, LETTERS, IDENTITY)
    if not len(words):
        return words, np.zeros((0, len(model.languages)))
    _, where, word = np.unique(words.hashes(), return_index=True, return_inverse=True)
    ids, first = features(words, where, model.lexicon)
    scores = _word_scores(model.weights, ids, first).astype(np.float64)[word]
    return words, forward_backward(scores, words.first, model.begin, model.transitions)


def predict(model: Model, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The number of each text's language (-1: no word) and its share of the posterior mass."""
    words, post = label(model, texts)
    mass = np.zeros((len(texts), max(len(model.languages), 1)))
    count = np.diff(words.first)
    if len(words) and model.languages:
        mass[count > 0] = np.add.reduceat(post, words.first[:-1][count > 0], axis=0) / count[count > 0, None]
    best = np.where((count > 0) & bool(model.languages), mass.argmax(axis=1), -1)
    return best, np.clip(mass.max(axis=1), 0, 1)


def sample(docs: DataFrame, learn) -> DataFrame:
    """About ``SAMPLE_DOCS`` rows of each language, ``SAMPLE_TOTAL`` and ``SAMPLE_CHARS`` at most, chosen by a hash of the id.

    Beyond that all languages give up rows down to one number, so rare ones keep theirs. Texts are read once the rows are chosen.
    """
    able = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}") & learn(F.col("doc_id")))
    part = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / (1 << 40)).alias("part")
    able = able.select("doc_id", "lang", part, F.xxhash64("text").alias("key"), F.length("text").alias("chars"), "text")
    sizes = able.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(SAMPLE_TOTAL)
    rows = able.drop("text").join(F.broadcast(sizes), "lang").where(F.col("part") * F.col("n") < SAMPLE_DOCS)  # SAMPLE_TOTAL names at most
    order = W.partitionBy("lang").orderBy("part", "doc_id", "key")  # about SAMPLE_DOCS light rows a language
    rows = rows.withColumn("rank", F.row_number().over(order)).withColumn("before", F.sum("chars").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("chars"))
    share = sizes.agg((F.lit(SAMPLE_CHARS) / F.count("*")).alias("share"))
    rows = rows.crossJoin(F.broadcast(share)).where("before < share")  # one row
    drawn = rows.orderBy("rank", "part", "doc_id", "key").limit(SAMPLE_TOTAL).select("doc_id", "lang", "key").distinct()
    return able.join(F.broadcast(drawn), ["doc_id", "lang", "key"]).select("doc_id", "lang", F.lower("text").alias("text"))  # SAMPLE_TOTAL rows at most


def fit(docs: DataFrame, learn=lambda doc_id: F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 != 2) -> Model:
    """A model from rows whose id ``learn`` accepts. With fewer than two languages its scores are flat; with none every text is unknown."""
    got = fetch(sample(docs, learn)).to_pandas().sort_values(["doc_id", "lang", "text"], kind="stable")
    return train([x.encode() for x in got["text"]], list(got["lang"]))


def add_language(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; columns of those names are replaced.

    Null texts and texts without a letter are ``und`` with score 0. Rows are judged one by one, so repeats agree; an empty table stays
    empty. Of languages with equal mass the first by name is taken. Very long texts are judged whole, as a batch of their own.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.columns
    low = free_name(docs, "low")
    sent = docs.withColumn(low, F.when(F.col("text").rlike(r"\p{L}"), F.lower("text")))
    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batches):
        m = shared.value
        names = np.array([*m.languages, UNKNOWN], dtype=object)
        for b in batches:
            best, score = [np.zeros(0, np.int64)], [np.zeros(0)]
            for _, _, texts in slices(b.column(low), BYTES):
                k, s = predict(m, texts)
                best.append(k)
                score.append(np.where(k < 0, 0, s))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(names[np.concatenate(best)], pa.string()), pa.array(np.concatenate(score), pa.float64())], [*kept, "lang_pred", "score"])

    return sent.mapInArrow(run, schema)


def switches(model: Model, text: str) -> list[tuple[str, str, float]]:
    """Word by word labels of one text: (word, language, posterior)."""
    words, post = label(model, [text.lower().encode()])
    data = words.data.tobytes()
    return [(data[a:b].decode("utf-8", "replace"), model.languages[k], float(p[k])) for a, b, p in zip(words.start, words.end, post, strict=True) for k in [p.argmax()]]


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = add_language(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", (crc_of_id(F.col("doc_id")) % 4 == 2).alias("held_out"), "lang_pred", "score")
