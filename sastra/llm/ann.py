"""Approximate nearest neighbours by an inverted file of coarse centroids with product-quantised residuals.

A bounded sample trains the coarse centroids and the residual codebooks in numpy. Every vector is indexed: it goes to its
nearest centroid's list with one byte a subspace. A query probes the lists of largest centroid product, bounds their rows' products by its
asymmetric distance tables (query times codebook, one table a subspace) and by what the codes leave out, and rescores every row that may
be among the best of its block exactly, in double precision, on the original vectors. How many lists are probed is measured at fit time on the sample.

Equal vectors are indexed once, with their smallest ids, so copies of one vector can't fill a list. Long lists and
lists that many queries probe are cut into a grid of blocks, each one task's work. A query's bound from the sample (no final
neighbour can lie below its k-th best there) keeps useless candidates from being shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.workers import ship
from .common import cut, fetch, read

K, EVERY = 20, 20
#: Vectors that the index is fitted on at most, lists at most, vectors for each list at least, subspaces at most, codes in a subspace.
SAMPLE, LISTS, PER_LIST, SUBSPACES, CODES = 16_384, 1024, 256, 16, 256
#: Part of the true neighbours that the probed lists must hold, queries that measure it, and vectors outside the sample among which they look too.
TARGET, PROBES, HELD_OUT = 0.97, 512, 8192
#: Rows and queries of a block, and pairs of both that are rescored at once.
ROWS, QUERIES, PAIRS = 8192, 2048, 32_768
SEED = 1


@dataclass
class Index:
    centroids: np.ndarray  # (lists, dim)
    codebooks: list[np.ndarray]  # by subspace (codes, width)
    edges: np.ndarray  # subspace borders
    probes: int
    sample: np.ndarray


def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 12) -> np.ndarray:
    centers = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centers)
        count = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        full = count > 0
        starts = (np.cumsum(count) - count)[full]
        centers[full] = np.add.reduceat(x[order], starts, axis=0) / count[full, None]
    return centers


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    half = (centers * centers).sum(axis=1) / 2
    return np.concatenate([(x[i : i + 4096] @ centers.T - half).argmax(axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def train(sample: np.ndarray, total: int, k: int, asked: np.ndarray | None = None, held_out: np.ndarray | None = None) -> Index:
    """Fit on (rows, dim) float32 vectors out of ``total``.

    How many lists to probe is measured on vectors of the queries, as they may lie unlike the rows (without ``asked``, on rows), and on neighbours in and
    out of the sample, each weighted by the rows it stands for: centroids fit their own sample better than other rows.
    """
    rng = np.random.default_rng(SEED)
    lists = int(np.clip(min(np.sqrt(total), len(sample) / 16, total / PER_LIST), 1, LISTS))
    centroids = _kmeans(sample, lists, rng)
    home = _nearest(sample, centroids)
    residual = sample - centroids[home]
    parts = min(SUBSPACES, sample.shape[1])
    edges = np.linspace(0, sample.shape[1], parts + 1).astype(int)
    books = [_kmeans(residual[:, a:b], min(CODES, len(sample)), rng, 8) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    if asked is None or not len(asked):
        asked = sample[rng.choice(len(sample), min(PROBES, len(sample)), replace=False)]
    rows = sample if held_out is None else np.concatenate([sample, held_out])
    near = asked @ rows.T
    place = {v.tobytes(): i for i, v in enumerate(rows)}
    for i, v in enumerate(asked):  # a query isn't its own neighbour
        near[i, place.get(v.tobytes(), [])] = -np.inf
    best = np.argpartition(-near, min(k, len(rows) - 1), axis=1)[:, :k]
    rank = np.argsort(np.argsort(-(asked @ centroids.T), axis=1), axis=1)
    need = np.take_along_axis(rank, _nearest(rows, centroids)[best], axis=1).ravel()
    weight = np.where(best.ravel() < len(sample), 1.0, (total - len(sample)) / max(len(rows) - len(sample), 1))
    share = np.cumsum(np.bincount(need, weight, lists)) / weight.sum()
    probes = min(int(np.searchsorted(share, TARGET)) + 1, lists)
    return Index(centroids, books, edges, probes, sample)


def encode(index: Index, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The list and the codes (rows, subspaces) of each vector."""
    home = _nearest(x, index.centroids)
    r = x - index.centroids[home]
    codes = np.stack([_nearest(r[:, a:b], book) for a, b, book in zip(index.edges[:-1], index.edges[1:], index.codebooks, strict=True)], axis=1)
    return home, codes.astype(np.uint8)


def search_block(index: Index, home: int, queries: np.ndarray, bound: np.ndarray, vectors: np.ndarray, codes: np.ndarray, k: int):
    """(query, row, score) triples of one block of the list ``home``: the ``k`` best of each query that reach its bound.

    A row's product is its distance tables' sum, give or take the query's length times what its codes leave out of the row. Every row whose product may be
    among the ``k`` best is rescored, so rows that the codes can't tell apart are all looked at.
    """
    center = index.centroids[home].astype(np.float64)
    decoded = np.concatenate([book[codes[:, m]] for m, book in enumerate(index.codebooks)], axis=1).astype(np.float64)
    longest = np.linalg.norm(vectors, axis=1)
    left_out = np.linalg.norm(vectors - center - decoded, axis=1)
    # rounding: the tables' sums have 24 bits, the rest 53
    dim = vectors.shape[1] + len(index.codebooks)
    left_out += dim * (2.0**-22 * np.linalg.norm(decoded, axis=1) + 2.0**-50 * (np.linalg.norm(center) + longest))
    longest = longest.max()
    out = []
    for lo in range(0, len(queries), 256):
        exact_q = queries[lo : lo + 256]
        q, length = exact_q.astype(np.float32), np.linalg.norm(exact_q, axis=1)
        approx = (exact_q @ center)[:, None] + sum((q[:, a:b] @ book.T)[:, codes[:, m]] for m, (a, b, book) in enumerate(zip(index.edges[:-1], index.edges[1:], index.codebooks, strict=True)))
        doubt = length[:, None] * left_out
        least = bound[lo : lo + 256]
        if len(vectors) > k:
            least = np.fmax(least, -np.partition(doubt - approx, k - 1, axis=1)[:, k - 1])
        able = ~(approx + doubt < least[:, None])
        rows = np.flatnonzero(able.any(axis=0))
        able = able[:, rows]
        exact = np.where(able, exact_q @ vectors[rows].T, -np.inf)
        # this product's last bits depend on the block's shape, so the best are taken with room for them and scored alike everywhere
        if len(rows) > k:
            able &= exact >= (-np.partition(-exact, k - 1, axis=1)[:, k - 1] - dim * 2.0**-50 * length * longest)[:, None]
        qi, at = np.nonzero(able)
        ri = rows[at]
        score = np.concatenate([np.zeros(0), *(np.einsum("pd,pd->p", exact_q[qi[i : i + PAIRS]], vectors[ri[i : i + PAIRS]]) for i in range(0, len(qi), PAIRS))])
        order = np.lexsort((ri, -score, qi))  # equal products go by row, that is by smaller id
        qi, ri, score = qi[order], ri[order], score[order]
        good = (np.arange(len(qi)) - np.searchsorted(qi, qi) < k) & (score >= bound[lo : lo + 256][qi])
        out.append((qi[good] + lo, ri[good], score[good]))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def _matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1) if len(column) else np.zeros((0, 1), kind)


def _classes(rows: DataFrame, k: int) -> DataFrame:
    """(v, ids): distinct vectors with their k + 1 smallest ids. Copies meet within a partition first, so no group outgrows the number of tasks."""
    kind = dict(rows.dtypes)["v"]

    def shrink(batches):
        held: dict[bytes, list[int]] = {}
        size = 0

        def flush():
            keys = [np.frombuffer(x, np.float64) for x in held]
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.list_(pa.float64())), pa.array(list(held.values()), pa.list_(pa.int64()))], ["v", "ids"])

        for b in batches:
            for i, v in zip(b.column("vec_id").to_pylist(), _matrix(b.column("v")), strict=True):
                ids = held.setdefault((v + 0.0).tobytes(), [])
                ids.append(i)
                if len(ids) > 4 * k:
                    ids[:] = sorted(set(ids))[: k + 1]
            size += b.num_rows
            if len(held) > 20_000:
                yield flush()
                held.clear()
        if held:
            yield flush()

    local = rows.mapInArrow(shrink, "v array<double>, ids array<long>")
    merged = local.groupBy("v").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))
    return merged.withColumn("v", F.col("v").cast(kind))


def valid(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): vectors that take part: not null, not empty, not zero, all components finite."""
    rows = embeddings.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    bad = F.exists("v", lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    return rows.where(~bad & F.exists("v", lambda x: x != 0))


def nearest(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of largest inner product for each query, rows of its own id excepted; ties to smaller ids.

    Both take (vec_id, v) as :func:`valid` gives them. An inner product needs equal lengths, so vectors of each length have an index of their own. Repeated
    (id, vector) rows count once; further vectors of an id are rows and queries of their own. Without rows or queries the result is empty.
    """
    lengths = sorted(r["d"] for r in rows.select(F.size("v").alias("d")).distinct().collect())  # a handful: one row a length
    out = None
    for d in lengths or [0]:
        one = _one_length(*(x.where(F.size("v") == d) if len(lengths) > 1 else x for x in (rows, queries)), k)
        out = one if out is None else out.unionByName(one)
    return out


def _one_length(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """:func:`nearest` for vectors of one length."""
    spark = rows.sparkSession
    ship(spark)
    classes = cut(_classes(rows, k))
    total = classes.count()
    sample = fetch(classes.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE + HELD_OUT))
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # equal queries ask once; one id may ask with several vectors
    asked = queries.groupBy("v").agg(F.min("vec_id").alias("q"))
    asked = cut(asked.select("v", F.concat(F.col("q").cast("string"), F.lit(":"), F.hex(F.xxhash64("v"))).alias("q")))
    some = fetch(asked.select("v").orderBy(F.xxhash64("v"), "v").limit(PROBES))
    vectors = lambda t: _matrix(t.column("v").combine_chunks(), np.float32) + np.float32(0)
    sample = vectors(sample)
    index = train(sample[:SAMPLE], total, k, vectors(some), sample[SAMPLE:])
    model = spark.sparkContext.broadcast(index)
    longest = float(np.linalg.norm(index.sample.astype(np.float64), axis=1).max())
    kind = dict(rows.dtypes)["v"]

    def add(batches):
        for b in batches:
            home, codes = encode(model.value, _matrix(b.column("v"), np.float32))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home, pa.int32()), pa.array([x.tobytes() for x in codes], pa.binary())], [*b.schema.names, "list", "codes"])

    indexed = cut(classes.mapInArrow(add, f"v {kind}, ids array<long>, list int, codes binary"))
    held = np.zeros(len(index.centroids), np.int64)
    for row in indexed.groupBy("list").count().collect():  # LISTS rows at most
        held[row["list"]] = row["count"]

    def probe(batches):
        m = model.value
        for b in batches:
            q = _matrix(b.column("v"))
            lists = np.argsort(-(q @ m.centroids.T), axis=1, kind="stable")
            before = np.cumsum(held[lists], axis=1) - held[lists]
            few = before < 2 * (k + 1)  # so many rows count whatever their score, so that a query finds k rows
            near = q @ m.sample.T.astype(np.float64)
            # the sample is rounded to 24 bits, so a product may be off by 2**-24 of the lengths' product
            slack = 2.0**-22 * np.linalg.norm(q, axis=1) * longest + 1e-300
            bound = -np.partition(-near, k + 1, axis=1)[:, k + 1] - slack if near.shape[1] > k + 1 else np.full(len(q), -np.inf)
            at, order = np.nonzero(few | (np.arange(lists.shape[1]) < m.probes)[None])
            bounds = np.where(few, -np.inf, bound[:, None])[at, order]
            yield pa.RecordBatch.from_arrays([b.column("q").take(pa.array(at)), b.column("v").take(pa.array(at)), pa.array(bounds), pa.array(lists[at, order].astype(np.int32))], ["q", "v", "bound", "list"])

    probes = cut(asked.mapInArrow(probe, f"q string, v {kind}, bound double, list int"))
    cuts = spark.createDataFrame(pd.DataFrame({"list": np.arange(len(index.centroids), dtype=np.int32)}))
    for df, name, size in ((indexed, "r", ROWS), (probes, "c", QUERIES)):
        cuts = cuts.join(df.groupBy("list").agg(F.ceil(F.count("*") / size).cast("int").alias(name)), "list")
    cuts = F.broadcast(cut(cuts))  # LISTS rows at most
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = probes.join(cuts, "list").withColumn("c", F.pmod(F.xxhash64("q"), F.col("c")).cast("int")).withColumn("r", every("r"))
    right = indexed.join(cuts, "list").withColumn("r", F.pmod(F.xxhash64(F.col("ids")[0]), F.col("r")).cast("int")).withColumn("c", every("c"))

    def run(key, ask, have):
        if not (ask.num_rows and have.num_rows):
            return pa.table({"q": pa.array([], pa.string()), "score": pa.array([], pa.float64()), "ids": pa.array([], pa.list_(pa.int64()))})
        have = have.take(pc.sort_indices(pc.list_element(have.column("ids"), 0)))  # ties go to smaller ids
        column = lambda t, name: t.column(name).combine_chunks()
        codes = np.frombuffer(b"".join(column(have, "codes").to_pylist()), np.uint8).reshape(have.num_rows, -1)
        qi, row, score = search_block(model.value, key[0].as_py(), _matrix(column(ask, "v")), column(ask, "bound").to_numpy(), _matrix(column(have, "v")), codes, k + 1)
        return pa.table({"q": column(ask, "q").take(pa.array(qi)), "score": pa.array(score), "ids": column(have, "ids").take(pa.array(row))})

    by = ("list", "r", "c")
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, "q string, score double, ids array<long>")
    pairs = F.flatten(F.transform(F.collect_list(F.struct("score", "ids")), lambda c: F.transform(c["ids"], lambda i: F.struct((-c["score"]).alias("s"), i.alias("i")))))
    best = found.groupBy("q").agg(F.slice(F.array_sort(pairs), 1, k + 1).alias("best"))
    members = queries.dropDuplicates(["vec_id", "v"]).join(asked.withColumnRenamed("v", "w"), F.col("v") == F.col("w")).select("vec_id", "q")
    out = members.join(best, "q").select(F.col("vec_id").alias("query_id"), F.slice(F.filter("best", lambda x: x["i"] != F.col("vec_id")), 1, k).alias("best"))
    return out.select("query_id", F.posexplode("best").alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.i").alias("vec_id"), (-F.col("x.s")).alias("score"))


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, rank, vec_id, score): neighbours of every vector whose id is divisible by 20. Vectors that take no part are neither queries nor neighbours; see :func:`nearest`."""
    rows = valid(read(spark, sf_dir, "embeddings"))
    return nearest(rows, rows.where(F.col("vec_id") % EVERY == 0))
