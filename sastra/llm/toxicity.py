"""Toxicity by a convolutional text classifier with hashed word embeddings.

Words and their stems (first four bytes) fall into hash buckets; a word's embedding is the sum of both buckets' learned ones. Filters of several widths slide over them, each filter keeps its
maximum over the whole text, and a logistic layer turns the maxima into a score. Training is plain numpy with Adam on a bounded
sample of labelled rows. A threshold is calibrated for each language on part of the sample, where the language at prediction time is guessed from the
text's own words, never from a column; scores are shifted so that the threshold lies at 0.5.

Executors hold the model (about 13 MB, broadcast) and two megabytes of text at a time, so memory doesn't grow with the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import FOLD, LETTERS, Words, crc_of_id, fetch, read, slices, small_batches

BUCKETS = 1 << 15
DIM, FILTERS, WIDTHS, STEM = 16, 16, (1, 2, 3), 4
#: Labelled rows that the model is fitted on at most, for each label, and characters of their texts: rows are drawn by a hash of
#: the id, whatever their length, until either is reached (the last row may pass it).
SAMPLE_ROWS = 4000
SAMPLE_CHARS = 24_000_000
#: Buckets that fewer texts of the sample hold share one embedding, so that chance words aren't learned by heart.
LEAST_DOCS = 6
EPOCHS, BATCH, RATE, SEED = 10, 32, 0.01, 9
#: Part of a text's words that a training step leaves out at random, so that the score doesn't hang on a few words; scoring takes all words.
WORD_DROPOUT = 0.3
#: Words that training turns into arrays at once.
PORTION = 16_384
#: Of the sample, one row in so many serves the thresholds.
CALIBRATION = 5


@dataclass
class Model:
    #: For each width, the embedding table times the filter's slice at each offset: arrays (BUCKETS + 1, FILTERS).
    tables: list[list[np.ndarray]]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    #: log p(bucket | language), (BUCKETS, languages), and the logit at which a text of that language counts as toxic.
    profile: np.ndarray
    cutoff: np.ndarray


def buckets_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of every word and of its stem, (words, 2), and each text's first word (with one entry more at the end)."""
    words = Words(texts, LETTERS, FOLD)
    sums = words.sums()
    whole = words.spans(sums, words.start, words.end)
    stem = words.spans(sums, words.start, np.minimum(words.start + STEM, words.end)) * np.uint64(0x9E3779B97F4A7C15)
    return (np.stack([whole, stem], axis=1) >> np.uint64(49)).astype(np.int32), words.first


def _layout(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens with padding after each text, and where each word went."""
    pad = max(WIDTHS) - 1
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.arange(len(ids)) + pad * doc
    tokens = np.full((len(ids) + pad * (len(first) - 1), 2), BUCKETS, np.int32)
    tokens[at] = ids
    return tokens, at


def _segment_max(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The maximum of each text's rows; zero for texts without words."""
    out = np.zeros((len(first) - 1, x.shape[1]), np.float32)
    full = np.diff(first) > 0
    if full.any():
        out[full] = np.maximum.reduceat(x, first[:-1][full], axis=0)
    return out


def logits(model: Model, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    tokens, at = _layout(ids, first)
    z = np.full(len(first) - 1, model.out_bias, np.float64)
    for k, width in enumerate(WIDTHS):
        x = np.zeros((len(ids), FILTERS), np.float32)
        for o in range(width):
            for part in (0, 1):
                x += model.tables[k][o][tokens[at + o, part]]
        top = np.maximum(_segment_max(x, first) + model.bias[k], 0).astype(np.float64)
        for f in range(FILTERS):  # one order of addition, so that a score doesn't depend on the texts beside it
            z += top[:, f] * float(model.out[k][f])
    # a text without words has no maxima: its score is the bias alone
    empty = np.diff(first) == 0
    z[empty] = model.out_bias
    return z


def languages(model: Model, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The index of the language whose word profile fits each text best."""
    total = np.zeros((len(first) - 1, model.profile.shape[1]))
    full = np.diff(first) > 0
    if full.any():
        total[full] = np.add.reduceat(model.profile[ids[:, 0]].astype(np.float64), first[:-1][full], axis=0)
    return total.argmax(axis=1)


def scores(model: Model, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    z = logits(model, ids, first) - model.cutoff[languages(model, ids, first)]
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class _Adam:
    def __init__(self, shape):
        self.m, self.v, self.t = np.zeros(shape, np.float32), np.zeros(shape, np.float32), 0

    def step(self, x: np.ndarray, g: np.ndarray, rate: float) -> None:
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.001 * (g * g - self.v)
        x -= rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def _portions(docs: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Runs of texts of about ``PORTION`` words; a longer text is a run of its own."""
    held, size = [], 0
    for d in docs:
        if held and size + len(d) > PORTION:
            yield held
            held, size = [], 0
        held.append(d)
        size += len(d)
    if held:
        yield held


def _thinned(words: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    kept = rng.random(len(words)) >= WORD_DROPOUT
    return words[kept] if kept.any() else words


def train(docs: list[np.ndarray], label: np.ndarray, lang: np.ndarray) -> Model:
    """Fit on word buckets of whole texts, 0/1 labels and language numbers."""
    rng = np.random.default_rng(SEED)
    # dense numbers for the buckets that are learned; 0 is the padding, 1 all other words
    held_by = np.zeros(BUCKETS + 1, np.int64)
    for d in docs:
        held_by[np.unique(d)] += 1
    number = np.ones(BUCKETS + 1, np.int32)
    number[held_by >= LEAST_DOCS] = np.arange((held_by >= LEAST_DOCS).sum()) + 2
    number[BUCKETS] = 0
    embed = rng.normal(0, 0.1, (int(number.max()) + 1, DIM)).astype(np.float32)
    embed[0] = 0
    taps = [(k, o) for k, w in enumerate(WIDTHS) for o in range(w)]
    conv = rng.normal(0, 0.25, (DIM, len(taps), FILTERS)).astype(np.float32)
    bias = np.zeros((len(WIDTHS), FILTERS), np.float32)
    out = rng.normal(0, 0.25, (len(WIDTHS), FILTERS)).astype(np.float32)
    out_bias = np.zeros(1, np.float32)
    scale = np.full(len(embed), 1e-6, np.float32)  # AdaGrad by row for the embeddings, whose gradients are sparse
    opts = [_Adam(x.shape) for x in (conv, bias, out, out_bias)]
    calibration = np.arange(len(docs)) % CALIBRATION == 0 if len(docs) >= 50 else np.zeros(len(docs), bool)
    usable = np.flatnonzero(~calibration & np.array([len(d) > 0 for d in docs], bool))
    for epoch in range(EPOCHS if len(usable) else 0):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(usable)
        for b in range(0, len(order), BATCH):
            pick = order[b : b + BATCH]
            table = (embed @ conv.reshape(DIM, -1)).reshape(len(embed), len(taps), FILTERS)
            y, z, tape, rows_of = label[pick].astype(np.float32), np.full(len(pick), out_bias[0], np.float32), [], {t: [] for t in range(len(taps))}
            tops: list[list[np.ndarray]] = [[] for _ in WIDTHS]
            for part in _portions([_thinned(docs[i], rng) for i in pick]):
                first = np.concatenate([[0], np.cumsum([len(d) for d in part])])
                tokens, at = _layout(np.concatenate(part), first)
                tokens = number[tokens]
                for k, width in enumerate(WIDTHS):
                    x = sum(table[tokens[at + o, side], taps.index((k, o))] for o in range(width) for side in (0, 1))
                    top = _segment_max(x, first)
                    hit_row, hit_f = np.nonzero(x == np.repeat(top, np.diff(first), axis=0))
                    doc = np.searchsorted(first, hit_row, "right") - 1
                    where = np.zeros((len(part), FILTERS), np.int64)
                    where[doc[::-1], hit_f[::-1]] = hit_row[::-1]  # the first place of each maximum
                    tops[k].append(top)
                    for o in range(width):
                        rows_of[taps.index((k, o))].append(tokens[at[where] + o])  # (texts, filters, 2)
            for k in range(len(WIDTHS)):
                act = np.concatenate(tops[k]) + bias[k]
                z += np.maximum(act, 0) @ out[k]
                tape.append(act)
            dz = (1 / (1 + np.exp(-z)) - y) / len(pick)
            touched, grads = [], []
            d_conv, d_bias, d_out = 1e-4 * conv, np.zeros_like(bias), 1e-4 * out
            for t, (k, o) in enumerate(taps):
                act = tape[k]
                da = dz[:, None] * out[k][None, :] * (act > 0)
                rows = np.concatenate(rows_of[t])
                d_conv[:, t] += np.einsum("df,dfe->ef", da, embed[rows].sum(axis=2))
                for part in (0, 1):
                    touched.append(rows[:, :, part].ravel())
                    grads.append((da[:, :, None] * conv[:, t].T[None]).reshape(-1, DIM))
                if o == 0:
                    d_bias[k] = da.sum(0)
                    d_out[k] += np.maximum(act, 0).T @ dz
            for opt, value, g in zip(opts, (conv, bias, out, out_bias), (d_conv, d_bias, d_out, dz.sum(keepdims=True)), strict=True):
                opt.step(value, g, rate)
            rows, back = np.unique(np.concatenate(touched), return_inverse=True)
            g = np.zeros((len(rows), DIM), np.float32)
            np.add.at(g, back, np.concatenate(grads))
            scale[rows] += (g * g).mean(axis=1)
            embed[rows] -= 5 * rate * g / np.sqrt(scale[rows])[:, None]
            embed[0] = 0
    n_lang = max(int(lang.max()) + 1 if len(lang) else 1, 1)
    counts = np.full((BUCKETS, n_lang), 0.1)
    for d, k in zip(docs, lang, strict=True):
        counts[:, k] += np.bincount(d[:, 0], minlength=BUCKETS)
    model = Model(
        [[(embed @ conv[:, taps.index((k, o))])[number] for o in range(w)] for k, w in enumerate(WIDTHS)],
        list(bias), out, float(out_bias[0]), np.log(counts / counts.sum(0)).astype(np.float32), np.zeros(n_lang),
    )
    held = np.flatnonzero(calibration)
    if len(held):
        z, guess, y = [], [], label[held]
        for part in _portions([docs[i] for i in held]):
            first = np.concatenate([[0], np.cumsum([len(d) for d in part])])
            ids = np.concatenate(part).astype(np.int32)
            z.append(logits(model, ids, first))
            guess.append(languages(model, ids, first))
        z, guess = np.concatenate(z), np.concatenate(guess)
        model.cutoff = np.array([_threshold(z[guess == k], y[guess == k]) for k in range(n_lang)])
    return model


def _threshold(z: np.ndarray, y: np.ndarray, least: int = 10, clean_weighs: float = 3) -> float:
    """The logit with the best weighted accuracy of the two labels; 0 with too few rows of either label."""
    if min((y == 1).sum(), (y == 0).sum()) < least:
        return 0.0
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    below = clean_weighs * np.concatenate([[0], np.cumsum(y == 0)]) / (y == 0).sum()
    above = 1 - np.concatenate([[0], np.cumsum(y == 1)]) / (y == 1).sum()
    good = np.flatnonzero(np.isclose(below + above, (below + above).max()))
    edges = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    return float(np.clip(edges[good].mean(), -4, 4))


def _encode(batches):
    """Executors send word buckets, not texts, for the sample."""
    for b in batches:
        for lo, hi, texts in slices(b.column("text")):
            ids, first = buckets_of(texts)
            raw = [ids[first[i] : first[i + 1]].astype(np.uint16).tobytes() for i in range(hi - lo)]
            part = b.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), part.column("lang"), pa.array(raw, pa.binary())], ["doc_id", "toxic", "lang", "ids"])


def constant(n: int, toxic: int) -> Model:
    """The model of ``n`` rows that don't hold both labels: every text scores the smoothed share of toxic rows, a quarter without any row."""
    share = (toxic + 0.5) / (n + 2)
    tables = [[np.zeros((BUCKETS + 1, FILTERS), np.float32) for _ in range(w)] for w in WIDTHS]
    zeros = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    return Model(tables, zeros, np.zeros((len(WIDTHS), FILTERS), np.float32), float(np.log(share / (1 - share))), np.zeros((BUCKETS, 1), np.float32), np.zeros(1))


def sample(docs: DataFrame, labels: DataFrame, learn) -> pa.Table:
    """Labelled rows of each label within ``SAMPLE_ROWS`` and ``SAMPLE_CHARS``, chosen by a hash of the id; texts become word buckets.

    An id with both labels counts as toxic; of the texts of a repeated id the one of smallest hash is taken.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(learn(F.col("doc_id")))
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = known.where("toxic = 1").orderBy(*order).limit(SAMPLE_ROWS).union(known.where("toxic = 0").orderBy(*order).limit(SAMPLE_ROWS))
    rows = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"), F.coalesce("lang", F.lit("")).alias("lang"), "text")
    sizes = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct("key", F.length("text").alias("n"))).alias("x"))  # 2 * SAMPLE_ROWS rows at most
    before = F.sum("n").over(W.partitionBy("toxic").orderBy(*order)) - F.col("n")
    drawn = sizes.select("doc_id", "toxic", "x.*").withColumn("before", before).where(F.col("before") < SAMPLE_CHARS).select("doc_id", "toxic", "key")
    rows = rows.join(F.broadcast(drawn), ["doc_id", "key"]).select("doc_id", "toxic", "lang", "text")  # 2 * SAMPLE_ROWS rows at most
    return fetch(rows.mapInArrow(_encode, "doc_id long, toxic int, lang string, ids binary").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max(F.struct("lang", "ids")).alias("x")).select("doc_id", "toxic", "x.*"))


def fit(docs: DataFrame, labels: DataFrame, learn=lambda doc_id: F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 != 0) -> Model:
    """A model from the rows whose id ``learn`` accepts. Without rows of both labels it scores every text the same (:func:`constant`)."""
    small_batches(docs.sparkSession)
    got = sample(docs, labels, learn).to_pandas().sort_values("doc_id", kind="stable")
    if got["toxic"].nunique() < 2:
        return constant(len(got), int(got["toxic"].sum()))
    got = got.sample(frac=1, random_state=SEED)  # labels alternate at random before the calibration rows are taken
    names = {x: i for i, x in enumerate(sorted(set(got["lang"])))}
    return train([np.frombuffer(x, np.uint16).reshape(-1, 2) for x in got["ids"]], got["toxic"].to_numpy(), got["lang"].map(names).to_numpy(np.int64))


def add_scores(docs: DataFrame, model: Model, score: str = "score") -> DataFrame:
    """``docs`` (any columns; one named like ``score`` is replaced) with the score of every whole text.

    Null texts and texts without words get the score of the bias. An empty table stays empty. A text's score depends on the
    text alone, not on those it shares a batch with, so repeated rows agree to the last bit.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(score)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select("*", F.lit(0.0).alias(score)).schema

    def run(batches):
        for b in batches:
            found = [scores(shared.value, *buckets_of(texts)) for _, _, texts in slices(b.column("text"))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())], [*b.schema.names, score])

    return docs.mapInArrow(run, schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs, read(spark, sf_dir, "labels"))
    out = add_scores(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (crc_of_id(F.col("doc_id")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
