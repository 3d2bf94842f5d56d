"""Near copies: first links come from SimHash fingerprints, and sets are not sent with every pair."""

import itertools
import random

import numpy as np

from veilscan.llm import simhash
from veilscan.llm.common import components, label_by_min, stored


def words(rng, n):
    return ["".join(rng.choice("abcdefghijkl") for _ in range(7)) for _ in range(n)]


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def shuffled(spark):
    """Bytes that this session's executors have written to shuffles."""
    seen = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(seen.apply(k).totalShuffleWrite() for k in range(seen.size()))


def test_long_texts_of_many_pairs(spark):
    rng = random.Random(5)
    runs = [words(rng, 100) for _ in range(120)]
    texts = [" ".join(w for r in rng.sample(runs, 60) for w in r) for _ in range(60)]  # each pair has about a third of its shingles in common
    near = texts[7].split()
    near[3000:3100] = words(rng, 100)
    texts.append(" ".join(near))
    before = shuffled(spark)
    kept = {r["doc_id"] for r in simhash.without_copies(table(spark, texts)).select("doc_id").collect()}
    assert kept == set(range(60))
    sets = 8 * 6000 * len(texts)
    assert shuffled(spark) - before < 12 * sets  # of 1830 pairs with two sets each, thirty times as much as all sets


def test_fingerprint_links_by_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 60, dtype=np.int64)
    f = np.concatenate([base, base[:20], *(base ^ np.bitwise_or.reduce(np.int64(1) << rng.integers(0, 63, (k, 60)), axis=0) for k in (1, 4, 6, 8))])
    nodes = stored(spark.createDataFrame([(int(k) + 100, int(x)) for k, x in enumerate(f)], "node long, f0 long"), "nodes")
    got = simhash.fingerprint_links(nodes, simhash.BITS)
    rows = got.collect()
    u = f.view(np.uint64)
    assert all(r["a"] > r["b"] and np.bitwise_count(u[r["a"] - 100] ^ u[r["b"] - 100]) <= simhash.BITS for r in rows)
    near = [(a, b) for a, b in itertools.combinations(range(len(f)), 2) if np.bitwise_count(u[a] ^ u[b]) <= simhash.BITS]
    want = label_by_min(len(f), *(np.array(x) for x in zip(*near, strict=True)))
    root = {r["node"] - 100: r["root"] - 100 for r in components(got).collect()}
    assert [root.get(k, k) for k in range(len(f))] == want.tolist()


def test_copies_that_fingerprints_alone_find(spark, monkeypatch):
    monkeypatch.setattr(simhash, "_lists", lambda least: lambda it: (b.slice(0, 0) for b in it if False))
    rng, texts = random.Random(6), []
    for _ in range(30):
        own = words(rng, 400)
        texts += [" ".join(own), " ".join(own[:-1] + words(rng, 1)), " ".join(words(rng, 400))]
    kept = {r["doc_id"] for r in simhash.without_copies(table(spark, texts)).select("doc_id").collect()}
    assert {k for k in range(90) if k % 3 != 1} <= kept
    assert len(kept) < 65  # most copies go, without the lists of prefixes


def test_cells_are_exact(spark):
    rng = np.random.default_rng(4)
    own = rng.integers(0, 2**63, 9000, dtype=np.uint64)
    sets = [np.unique(own[a : a + n]) for a, n in zip(rng.integers(0, 900, 40), rng.integers(5000, 8000, 40), strict=True)]
    sets += [x[:300] for x in sets[:10]]
    pairs = [(a, b) for a, b in itertools.product(range(50), repeat=2) if a > b]
    wide = [simhash.parities(s, simhash.wide(len(s))).tobytes() for s in sets]
    assert len(wide[0]) == 8 * simhash.wide(len(sets[0])) > len(wide[-1]) == 8 * simhash.PARITY
    held = spark.createDataFrame([(k, len(s), s.tobytes(), bytes(w)) for k, (s, w) in enumerate(zip(sets, wide, strict=True))], "node long, n int, set binary, wide binary")
    ask = spark.createDataFrame(pairs, "a long, b long")
    both = {(a, b): len(np.intersect1d(sets[a], sets[b])) for a, b in pairs}
    want = {(a, b) for (a, b), x in both.items() if x >= 0.8 * (len(sets[a]) + len(sets[b]) - x)}
    for column, exact in (("set", True), ("wide", False)):
        got = [(r["a"], r["b"]) for r in simhash.judged(ask, held.withColumnRenamed(column, "data"), 0.8, 50 * 64000, exact).collect()]
        assert len(got) == len(set(got)) and (set(got) == want if exact else want <= set(got) < set(pairs))
    assert 0 < len(want) < len(pairs)
