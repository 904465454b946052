"""Near-duplicate detection by HyperMinHash.

Every document becomes a set of word shingles and a sketch of ``REGISTERS`` registers. A register keeps the smallest
hash of the set under a hash function of its own, compressed to its count of leading zeros (6 bits) and the bits after
the leading one (``MANTISSA``). Four registers make a band; documents that share a band are candidates. A candidate is
kept if the similarity estimated from equal registers, corrected for chance collisions of the compressed values, isn't
clearly below the threshold, and linked if the full sets confirm it.

Groups never become all their pairs. Equal sets collapse to one representative first. Then each bucket is tested as a star around its
member that shares most buckets with others (the original of a group of copies), and linked documents form components. Only buckets that still
hold several components are compared further: small ones pair by pair, large ones (texts around one shared passage, say) block against
block, where matrix products give all intersections and only links leave the task. Counts per bucket are pre-aggregated, and buckets are
joined, not gathered, so a bucket with a third of all rows spreads over tasks.

At similarity 0.85 a pair shares none of the 24 bands with probability 2e-8, and the estimate drops it with about 1e-7;
at 0.80 with 3e-6, and the estimate drops it with about 4e-8.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import FOLD, NOT_SPACE, Words, cut, discard, fetch, free_name, mix, read, release, slices, small_batches, store

REGISTERS, BAND, MANTISSA = 96, 4, 10
#: The estimate may lie so far below the threshold at least (six standard errors at 0.85; see :func:`slack`).
SLACK = 0.22
SHINGLE, PERCENT = 3, 85
#: Buckets of up to so many members are compared pair by pair, larger ones in blocks of about so many members and so many shingles at once.
SMALL, BLOCK, COLUMNS = 32, 256, 8192
_KEYS = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text as 52-bit hashes under the text's number (12 bits), sorted; and where each text begins."""
    words = Words(texts, NOT_SPACE, FOLD)
    h, first = words.hashes(), words.first
    count = np.diff(first)
    shingles = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    doc = np.repeat(np.arange(len(count)), shingles)
    at = np.arange(shingles.sum()) - np.repeat(np.cumsum(shingles) - shingles, shingles) + first[:-1][doc]
    x = np.zeros(len(at), np.uint64)
    for k in range(size):
        there = k < count[doc]
        x[there] = mix(x[there] * np.uint64(0x9E3779B97F4A7C15) + h[at[there] + k])
    keys = np.unique((doc.astype(np.uint64) << np.uint64(52)) | (x >> np.uint64(12)))
    return keys, np.searchsorted(keys, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(52))


def registers(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Compressed registers (texts, REGISTERS); 0 for a text without shingles."""
    full = np.diff(first) > 0
    out = np.zeros((len(first) - 1, REGISTERS), np.uint16)
    if full.any():
        x = keys << np.uint64(12)
        for i, key in enumerate(_KEYS):
            least = np.minimum.reduceat(x * key ^ (x >> np.uint64(29)), first[:-1][full])
            part, power = np.frexp(least.astype(np.float64))
            zeros = np.minimum(64 - power, 63).astype(np.uint16)
            out[full, i] = (zeros << np.uint16(MANTISSA)) | ((part * 2 - 1) * (1 << MANTISSA)).astype(np.uint16)
    return out


def bands(regs: np.ndarray) -> np.ndarray:
    """Band keys (texts, REGISTERS / BAND): the four registers of a band and its number, mixed."""
    packed = np.ascontiguousarray(regs).view(np.uint64)
    return mix(packed ^ mix(np.arange(1, packed.shape[1] + 1, dtype=np.uint64))).view(np.int64)


def expected_collisions(n: float, m: float, mantissa: int = MANTISSA) -> float:
    """The chance that a register of two disjoint sets of n and m shingles agrees: the sum over compressed values."""
    total = 0.0
    for zeros in range(60):
        edges = 2.0 ** -(zeros + 1) * (1 + np.arange((1 << mantissa) + 1) / (1 << mantissa))
        below_n, below_m = np.exp(n * np.log1p(-np.minimum(edges, 1 - 1e-16))), np.exp(m * np.log1p(-np.minimum(edges, 1 - 1e-16)))
        total += float(((below_n[:-1] - below_n[1:]) * (below_m[:-1] - below_m[1:])).sum())
    return total


def estimated_similarity(a: str, b: str, n: str, m: str):
    """The collision-corrected Jaccard estimate of register arrays ``a`` and ``b`` of sets of ``n`` and ``m`` shingles.

    The chance of a collision is close to c * 2**-MANTISSA * n * m / (n + m)**2, where c = 1 / (2 ln 2) is what a cell's
    width over its value comes to on average (:func:`expected_collisions` is the full sum).
    """
    equal = f"aggregate(zip_with({a}, {b}, (x, y) -> if(x = y, 1, 0)), 0, (s, x) -> s + x)"
    chance = f"({float(0.5 / np.log(2))!r} / {1 << MANTISSA} * {n} * {m} / pow(cast({n} as double) + {m}, 2))"
    return F.expr(f"({equal} / {float(REGISTERS)!r} - {chance}) / (1 - {chance})")


def sketches(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(id, n, s1, s2, regs, bands): the set's size, two order-free sums that stand for the set, registers and band keys."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            for lo, hi, texts in slices(b.column("text")):
                keys, first = shingle_sets(texts, size)
                sums = [np.zeros(len(texts), np.uint64) for _ in "12"]
                full = np.diff(first) > 0
                if full.any():
                    for s, salt in zip(sums, (1, 2), strict=True):
                        s[full] = np.add.reduceat(mix((keys << np.uint64(12)) + np.uint64(salt)), first[:-1][full])
                regs = registers(keys, first)
                groups = bands(regs)
                lists = lambda x: pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(lo, hi - lo), pa.array(np.diff(first).astype(np.int64)), *[pa.array(s.view(np.int64)) for s in sums], lists(regs.view(np.int16)), lists(groups)],
                    ["id", "n", "s1", "s2", "regs", "bands"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    return rows.mapInArrow(run, "id long, n long, s1 long, s2 long, regs array<short>, bands array<long>")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """(id, shingles array<long>): the full sets."""

    def run(batches):
        for b in batches:
            for lo, hi, texts in slices(b.column("text")):
                keys, first = shingle_sets(texts, size)
                values = pa.array((keys & np.uint64((1 << 52) - 1)).view(np.int64))
                yield pa.RecordBatch.from_arrays([b.column("id").slice(lo, hi - lo), pa.ListArray.from_arrays(first.astype(np.int32), values)], ["id", "shingles"])

    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(run, "id long, shingles array<long>")


#: Rows of a part of a small table: parts would else be as many as shuffles have, most of them empty. Rows of a few numbers that are made from rows like them take larger parts.
PART_ROWS, NARROW_ROWS = 4096, 32_768
#: So many links (16 bytes each) are followed on the driver, more of them in rounds on the executors: a round's stages cost the driver more than those links.
LOCAL_LINKS = 100_000


def in_parts(df: DataFrame, rows: int, each: int = PART_ROWS) -> DataFrame:
    """``df`` of about ``rows`` rows in no more parts than those need; never in more than it has."""
    return df.coalesce(max(8, rows // each))


def narrow(df: DataFrame, rows: int) -> DataFrame:
    """:func:`in_parts` for rows of a few numbers."""
    return in_parts(df, rows, NARROW_ROWS)


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ends of the links (a, b) and the smallest end reachable from each: roots hook onto smaller labels, then all paths are halved to their roots."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    comp = np.arange(len(ids))
    while (comp[x] != comp[y]).any():
        cx, cy = comp[x], comp[y]
        np.minimum.at(comp, np.maximum(cx, cy), np.minimum(cx, cy))
        while (comp != (up := comp[comp])).any():
            comp = up
    return ids, ids[comp]


def components(links: DataFrame) -> DataFrame:
    """(id, comp) of every end of (a, b) links, comp the smallest id reachable: up to ``LOCAL_LINKS`` links on the driver, more by :func:`spread_labels`."""
    links = links.select("a", "b")
    if links.count() > LOCAL_LINKS:
        return spread_labels(links)
    got = fetch(links)
    ids, comp = least_reachable(*(got.column(c).to_numpy().astype(np.int64) for c in "ab"))
    return cut(links.sparkSession.createDataFrame(pa.table({"id": ids, "comp": comp}), "id long, comp long"))


def spread_labels(links: DataFrame) -> DataFrame:
    """:func:`components` of any number of links: labels spread along links, to the ends and to the ends' labels, then jump to their label's label.

    As whole labels move, rounds grow with the logarithm of a chain's length and not with the length.
    """
    both = cut(links.select("a", "b").union(links.select("b", "a")).distinct())
    n = both.count()
    labels = cut(in_parts(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("comp")), n))
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("comp").alias("near"))
        offered = labels.join(near, labels["id"] == near["a"]).select("id", F.least("comp", "near").alias("low"), F.col("comp").alias("old"))
        offered = offered.union(offered.select(F.col("old").alias("id"), "low", F.lit(None).cast("long").alias("old")))
        spread = cut(narrow(offered.groupBy("id").agg(F.min("low").alias("comp"), F.max("old").alias("old")), n))
        top = spread.select(F.col("id").alias("__i"), F.col("comp").alias("__c"))
        jumped = cut(narrow(spread.join(top, spread["comp"] == top["__i"]).select("id", F.least("comp", "__c").alias("comp"), "old"), n))
        labels = jumped.select("id", "comp")
        del near, offered, spread, top
        release(links.sparkSession)
        if jumped.where("comp <> old").isEmpty():
            return labels


def slack(percent: int) -> float:
    """How far the estimate may lie below the threshold: six standard errors there, and ``SLACK`` at least."""
    return max(SLACK, 6 * (percent / 100 * (1 - percent / 100) / REGISTERS) ** 0.5)


#: (percent, words of a shingle): the documents that a rule links.
Rules = tuple[tuple[int, int], ...]


def _by_rule(rules: Rules, node: str, value) -> str:
    """SQL for ``value(percent)`` of the rule that a node belongs to."""
    if len(rules) == 1:
        return f"{value(rules[0][0])!r}"
    return f"case pmod({node}, {len(rules)}) {' '.join(f'when {r} then {value(p)!r}' for r, (p, _) in enumerate(rules))} end"


def _alike(rules: Rules, node: str, n: str, m: str) -> str:
    """Sizes that a similarity of the rule's percent allows."""
    return f"100 * least({n}, {m}) >= ({_by_rule(rules, node, lambda p: p)}) * greatest({n}, {m})"


def _confirm(pairs: DataFrame, regs: DataFrame, sets: DataFrame, rules: Rules, m: int) -> DataFrame:
    """Of (a, b) pairs those that the estimate leaves and the full sets confirm; ``m`` is about their number."""
    left, right = (regs.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("regs").alias(f"r{k}")) for k in "ab")
    near = pairs.join(left, "a").join(right, "b").where(F.expr(_alike(rules, "a", "na", "nb")))
    near = near.where(estimated_similarity("ra", "rb", "na", "nb") >= F.expr(_by_rule(rules, "a", lambda p: float(p / 100 - slack(p)))))
    near = cut(in_parts(near.select("a", "b"), m))
    full = near.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b").join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    common = full.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("c"), (F.size("sa") + F.size("sb")).alias("t"))
    return cut(in_parts(common.where(f"100 * c >= ({_by_rule(rules, 'a', lambda p: p)}) * (t - c)").select("a", "b").distinct(), m))


def _block_links(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in left, in right) of the sets that link; the sizes of all intersections come from products of 0/1 matrices."""
    sizes = [np.array([len(x) for x in side]) for side in (left, right)]
    flat = [np.concatenate(side) for side in (left, right)]
    common = np.intersect1d(*flat)
    rows, columns = [], []
    for side, values, n in zip((left, right), flat, sizes, strict=True):
        at = np.minimum(np.searchsorted(common, values), max(len(common) - 1, 0))
        keep = common[at] == values if len(common) else np.zeros(len(values), bool)
        rows.append(np.repeat(np.arange(len(side)), n)[keep])
        columns.append(at[keep])
    total = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, len(common), COLUMNS):
        parts = []
        for side, r, c in zip((left, right), rows, columns, strict=True):
            x = np.zeros((len(side), min(COLUMNS, len(common) - lo)), np.float32)
            mine = (c >= lo) & (c < lo + COLUMNS)
            x[r[mine], c[mine] - lo] = 1
            parts.append(x)
        total += parts[0] @ parts[1].T
    both = sizes[0][:, None] + sizes[1][None, :]
    return np.nonzero(100 * total.astype(np.int64) >= percent * (both - total.astype(np.int64)))


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the links (a, b) still join two parts when taken in order."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    out = np.zeros(len(a), bool)
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            parent[x], out[k] = y, True
    return out


def _in_blocks(placed: DataFrame, sets: DataFrame, rules: Rules, m: int) -> DataFrame:
    """(a, b) links within large buckets, whose members are dealt into blocks of about ``BLOCK``; only links leave a task.

    Of the links of two blocks those are kept that join different components, as a forest. A member's block lies in its largest bucket, so buckets of one group share blocks; blocks that meet in a bucket are compared once.
    A block's sets are of one size class, a power of 100 over the rule's percent: sets that link are of the same class or of the next. Components that fill blocks have blocks of their own.
    """
    home = placed.groupBy("id").agg(F.max(F.struct("size", "bucket")).alias("h"), F.first("comp").alias("comp"), F.min("n").alias("n"))
    width = F.expr(_by_rule(rules, "id", lambda p: float(np.log(100 / p) * (1 + 1e-9) if p < 100 else 1)))
    home = cut(narrow(home.select("id", "comp", F.col("h.bucket").alias("b"), F.floor(F.log("n") / width).alias("level")), m))
    whole = home.groupBy("b", "level", "comp").agg(F.count("*").alias("c"))
    whole = whole.withColumn("pure", F.when(F.col("c") >= BLOCK, F.col("comp")))
    rest = whole.groupBy("b", "level", "pure").agg(F.sum("c").alias("of"))
    whole = cut(narrow(whole.join(rest.withColumnRenamed("pure", "q"), ["b", "level"]).where(F.col("pure").eqNullSafe(F.col("q"))).select("b", "level", "comp", "pure", "of"), m))
    home = home.join(whole, ["b", "level", "comp"])
    home = cut(narrow(home.select("id", "comp", "level", "pure", F.xxhash64("b", "level", F.coalesce("pure", F.lit(-1)), F.pmod(F.xxhash64("id"), F.ceil(F.col("of") / BLOCK))).alias("block")), m))
    meet = placed.select("bucket", "id").join(home, "id").select("bucket", F.struct("block", "level", "pure").alias("x")).distinct()
    meet = meet.groupBy("bucket").agg(F.array_sort(F.collect_list("x")).alias("blocks"))
    pairs = meet.select(F.posexplode("blocks").alias("i", "x"), "blocks").select("x", F.explode(F.slice("blocks", F.col("i") + 1, F.size("blocks"))).alias("y"))
    alone = F.coalesce(F.col("x.pure") == F.col("y.pure"), F.lit(False))
    pairs = pairs.where((F.abs(F.col("x.level") - F.col("y.level")) <= 1) & ~alone).select(F.col("x.block").alias("x"), F.col("y.block").alias("y")).distinct()
    home = home.select("id", "comp", "block")
    held = sets.join(home, "id")
    sides = pairs.join(held, pairs["x"] == held["block"]).select("x", "y", F.lit(0).alias("side"), "id", "comp", "shingles")
    sides = sides.union(pairs.where("x <> y").join(held, F.col("y") == held["block"]).select("x", "y", F.lit(1).alias("side"), "id", "comp", "shingles"))

    def run(key, pdf):
        left = pdf[pdf["side"] == 0]
        right = left if key[0] == key[1] else pdf[pdf["side"] == 1]
        i, j = _block_links(list(left["shingles"]), list(right["shingles"]), rules[left["id"].iat[0] % len(rules)][0])
        found = pd.DataFrame({"a": left["id"].to_numpy()[i], "b": right["id"].to_numpy()[j], "ca": left["comp"].to_numpy()[i], "cb": right["comp"].to_numpy()[j]})
        found = found[found["ca"] != found["cb"]].drop_duplicates(["ca", "cb"])
        return found[_forest(found["ca"].to_numpy(), found["cb"].to_numpy())][["a", "b"]]

    return cut(sides.groupBy("x", "y").applyInPandas(run, "a long, b long"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of (doc_id, text).

    Documents link if 100 * intersection >= percent * union of their shingle sets; fewer words than ``size`` make one
    shingle; without words or text a document links with nothing. Rows that repeat an id count as one document. A
    null id can't be linked and has a null component. An empty table gives an empty result.
    """
    out = _near(docs, ((percent, size),))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("comp", "id")).alias("component_id"))


def _near(docs: DataFrame, rules: Rules) -> DataFrame:
    """(id, n, comp) for each row and rule: a document is a node of each rule, id * rules + the rule's place, and nodes link under their own rule. ``comp`` is the smallest node reachable, or null."""
    spark, count = docs.sparkSession, len(rules)
    known = None
    for r, (_, size) in enumerate(rules):
        one = sketches(docs, size)
        if count > 1:  # buckets are a rule's own
            one = one.withColumn("id", F.col("id") * count + r).withColumn("bands", F.transform("bands", lambda x, r=r: F.xxhash64(x, F.lit(r))))
        known = one if known is None else known.unionByName(one)
    sketched = store(known, "sketches")
    known = store(sketched.select("id", "n", "s1", "s2"), "known")
    n = known.count()
    able = sketched.where("n > 0 and id is not null").withColumn("r", F.pmod("id", F.lit(count)))
    classes = able.groupBy("r", "n", "s1", "s2").agg(F.min("id").alias("rep"))
    classes = store(in_parts(classes, n), "classes")
    reps = able.join(classes, ["r", "n", "s1", "s2"]).where("id = rep").dropDuplicates(["id", "n", "s1", "s2"]).select("id", "n", "regs", "bands")
    reps = store(in_parts(reps, n), "reps")
    del able
    discard(sketched)  # what is read from here on stands in the others
    release(spark)

    members = reps.select("id", "n", F.explode("bands").alias("bucket"))
    sizes = cut(in_parts(members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), n))
    members = cut(in_parts(members.join(sizes, "bucket"), 4 * n))
    m = members.count()
    score = cut(in_parts(members.groupBy("id").agg(F.sum("size").alias("score")), n))
    members = members.join(score, "id").select("bucket", "id", "n", "score")
    involved = score.select("id")
    regs = reps.join(involved, "id", "left_semi").select("id", "n", "regs")
    regs = cut(in_parts(regs, n))
    sets = None
    for r, (_, size) in enumerate(rules):
        mine = involved.where(F.pmod("id", F.lit(count)) == r).select(F.expr(f"(id - {r}) div {count}").alias("doc_id"))
        one = store(_sets(docs.join(mine, "doc_id", "left_semi"), size).withColumn("id", F.col("id") * count + r), "sets")
        sets = one if sets is None else sets.unionByName(one)
        release(spark)  # the texts were shuffled for the rule

    release(spark)

    leaders = members.groupBy("bucket").agg(F.max(F.struct("score", (-F.col("id")).alias("o"), F.col("id").alias("a"), F.col("n").alias("na"))).alias("l")).select("bucket", "l.a", "l.na")
    leaders = cut(narrow(leaders, m))
    star = members.join(leaders, "bucket").where(f"id <> a and pmod(id, {count}) = pmod(a, {count})").where(_alike(rules, "id", "n", "na"))
    tested = cut(narrow(star.select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct(), m))
    links = _confirm(tested, regs, sets, rules, m)
    del star, leaders
    release(spark)
    labels = components(links)
    release(spark)

    placed = members.join(labels, "id", "left").select("bucket", "id", "n", F.coalesce("comp", "id").alias("comp"))
    torn = placed.groupBy("bucket").agg(F.count("*").alias("size"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("bucket", "size")
    torn = cut(narrow(torn, m))
    placed = cut(narrow(placed.join(torn, "bucket"), m))
    few, many = placed.agg(F.count_if(F.col("size") <= SMALL), F.count_if(F.col("size") > SMALL)).first()
    if few:
        small = placed.where(f"size <= {SMALL}")
        other = small.select("bucket", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"))
        rest = small.withColumnRenamed("id", "a").join(other, "bucket").where(f"a < b and comp <> cb and pmod(a, {count}) = pmod(b, {count})").where(_alike(rules, "a", "n", "nb")).select("a", "b").distinct()
        rest = rest.join(tested, ["a", "b"], "left_anti")
        links = links.union(_confirm(rest, regs, sets, rules, few * SMALL))
        del rest, other, small
        release(spark)
    if many:
        links = links.union(_in_blocks(placed.where(f"size > {SMALL}"), sets, rules, many))
        release(spark)
    if few or many:
        labels = components(links)

    of_class = classes.join(labels, classes["rep"] == labels["id"], "left").select("r", "n", "s1", "s2", F.coalesce("comp", "rep").alias("comp"))
    return known.select("id", "n", "s1", "s2", F.pmod("id", F.lit(count)).alias("r")).join(of_class, ["r", "n", "s1", "s2"], "left").select("id", "n", "comp")


def _ties(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c, kind in docs.dtypes if c != "doc_id" and kind in ("string", "int", "bigint", "double", "boolean")]


def one_of_each(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, also: tuple[tuple[int, int], ...] = ()) -> DataFrame:
    """The rows of ``docs`` (all columns) with the smallest id of their component; rows with a null id stay.

    Of rows that repeat both id and text one stays; rows that repeat an id with another text stay beside it. Null and empty texts link with nothing and
    stay. An empty table stays empty. Documents link by ``percent`` and ``size``, or by any further (percent, size) in ``also``; components are those of all links.
    """
    texts, rules = docs.select(F.col("doc_id").cast("long"), "text"), ((percent, size), *also)
    far, n = texts.agg(F.max(F.abs(F.col("doc_id").cast("decimal(20,0)"))), F.count("*")).first()
    if len(rules) > 1 and (far or 0) >= (1 << 63) // len(rules) - 1:  # ids too large to number the nodes of several rules: one rule after the other
        passes = [(rule,) for rule in rules]
    else:
        passes = [rules]
    links = docs.sparkSession.createDataFrame([], "a long, b long")
    for some in passes:
        node = lambda c, k=len(some): F.expr(f"({c} - pmod({c}, {k})) div {k}")
        found = _near(texts, some).where("comp < id").select(node("comp").alias("a"), node("id").alias("b")).distinct()
        links = cut(in_parts(links.union(found), n * len(rules)))
        release(docs.sparkSession)
    gone = (components(links).where("comp < id") if len(rules) > 1 else links.withColumnRenamed("b", "id")).select(F.col("id").alias("doc_id")).distinct()
    place = free_name(docs, "n")
    first = W.partitionBy("doc_id", F.xxhash64("text")).orderBy(*_ties(docs))
    kept = docs.join(gone, "doc_id", "left_anti").withColumn(place, F.row_number().over(first))
    return kept.where((F.col(place) == 1) | F.col("doc_id").isNull()).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


SQL_NEAR_DEDUP = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[i:i + {SHINGLE - 1}] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= {PERCENT} * (na.n + nb.n - c)),
pairs AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id::BIGINT AS component_id, doc_id = component_id AS kept
FROM documents JOIN comp USING (doc_id) LEFT JOIN n USING (doc_id)
"""
