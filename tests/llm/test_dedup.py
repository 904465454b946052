import random

import numpy as np

from sastra.llm import near_dedup as N

SCHEMA = "doc_id long, text string"


def shingles(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({i: " " for i in range(9, 14)}).split(" ") if w]
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)} if len(words) >= 3 else ({tuple(words)} if words else set())


def brute(rows):
    sets = {}
    for i, t in rows:
        sets[i] = sets.get(i, set()) | shingles(t)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def corpus(seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(50)]
    out = []
    for g in range(6):
        base = [word() for _ in range(rng.randint(60, 200))]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
        out += [" ".join(base)] * 3
    out += [" ".join(passage + [word() for _ in range(rng.randint(4, 60))]) for _ in range(60)]
    out += ["", None, "A", "a", "a b", "A  B", "é É", "x y z", " ", "\t\n", "one two three four " * 2000]
    rng.shuffle(out)
    return list(enumerate(out))


def test_same_as_brute_force(spark):
    rows = corpus()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_large_buckets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "SMALL", 2)
    monkeypatch.setattr(N, "BLOCK", 8)
    rows = corpus(1)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_pure_blocks(spark, monkeypatch):
    """Components that fill blocks of their own, beside texts around one passage."""
    monkeypatch.setattr(N, "SMALL", 1)
    monkeypatch.setattr(N, "BLOCK", 2)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(60)]
    rows = [" ".join(passage + [f"w{i}" for i in range(k % 9)]) for k in range(40)] + [" ".join(passage[:40] + [word() for _ in range(20 + k)]) for k in range(40)]
    rows = list(enumerate(rows))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d"), (1, "a b c d"), (2, "A B C D"), (2, "A B C D"), (3, None)], SCHEMA)
    got = sorted([tuple(r) for r in N.near_duplicates(df).collect()], key=repr)
    assert got == sorted([(None, 2, None), (1, 2, 1), (2, 2, 1), (2, 2, 1), (3, 0, 3)], key=repr)
    assert N.near_duplicates(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e"), (1, "v w x y z"), (7, "V W X Y Z"), (8, "a b c d e")], SCHEMA)
    assert {r["doc_id"]: r["component_id"] for r in N.near_duplicates(twice).collect()} == {1: 1, 7: 1, 8: 1}
    assert sorted(r["text"] for r in N.one_of_each(twice).collect()) == ["a b c d e", "v w x y z"]
    more = df.selectExpr("doc_id", "text", "1 AS n", "2 AS id", "'x' AS bucket", "5 AS __n")
    kept = N.one_of_each(more)
    assert kept.columns == more.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 3] and {r["__n"] for r in kept.collect()} == {5}


def test_estimate_corrects_collisions():
    for n, m in ((10, 10), (300, 40), (1000, 900)):
        close = 0.5 / np.log(2) / (1 << N.MANTISSA) * n * m / (n + m) ** 2
        assert abs(N.expected_collisions(n, m) / close - 1) < 0.1
    texts = [" ".join(f"w{i}" for i in range(a, a + 400)).encode() for a in (0, 100)]
    keys, first = N.shingle_sets(texts)
    regs = N.registers(keys, first)
    assert abs((regs[0] == regs[1]).mean() - 298 / 498) < 0.2


def test_band_recall_at_the_threshold():
    assert (1 - 0.85**N.BAND) ** (N.REGISTERS // N.BAND) < 1e-7


def test_components_on_the_driver_and_in_rounds(spark, monkeypatch):
    """Few links are followed on the driver, more in rounds: both find the smallest id reachable."""
    rng = random.Random(3)
    chain = rng.sample(range(1000, 1200), 200)
    links = list(zip(chain, chain[1:])) + [(rng.randrange(400), rng.randrange(400)) for _ in range(150)] + [(-5, 1 << 62), (7, 7)]
    parent = {x: x for pair in links for x in pair}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    want = sorted((x, root(x)) for x in parent)
    df = spark.createDataFrame(links, "a long, b long")
    assert sorted(map(tuple, N.components(df).collect())) == want
    assert N.components(df.limit(0)).count() == 0
    monkeypatch.setattr(N, "LOCAL_LINKS", len(links) - 1)
    rounds = []
    monkeypatch.setattr(N, "release", lambda _: rounds.append(1))
    assert sorted(map(tuple, N.components(df).collect())) == want
    assert len(rounds) <= 10


def test_tasks_of_small_tables(spark):
    """The driver keeps something of every task: many shuffle partitions don't make as many parts of each small table, nor rounds of them."""
    rows = corpus(4)
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    context = spark.sparkContext
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        context.setJobGroup("dedup", "dedup")
        kept = N.one_of_each(spark.createDataFrame(rows, SCHEMA), 85, 3, also=((80, 5),)).count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("dedup")]
    assert 0 < kept < len(rows)
    assert len(jobs) < 140
