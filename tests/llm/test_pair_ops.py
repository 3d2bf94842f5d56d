"""Near copies, substrings, neighbours, the pipeline: against brute force."""

import hashlib
import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.conftest import SF
from veilscan.llm import ann, simhash, substrings
from veilscan.llm.common import components, label_by_min, stored

ODD = [(1, None, 5), (2, "", 5), (2, "", 5), (3, "one two", 5), (4, "a b c d e " * 3000, 5), (9, "a b c d e " * 3000, 5), (None, "one two", 5), (5, "One\ttwo", 5), (6, "日本 語 🙂 text", 5)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, component_id int")


def fingerprint(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    hs = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum((2 * sum(h >> b & 1 for h in hs) > len(hs)) << b for b in range(64))


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_op2(spark, odd, which):
    df = spark.read.parquet(f"{SF}/documents.parquet") if which == "docs" else odd
    rows = [(r["doc_id"], fingerprint(r["text"])) for r in df.collect()]
    f = np.array([x for _, x in rows], np.uint64)
    a, b = np.nonzero(np.bitwise_count(f[:, None] ^ f[None]) <= 4)
    label = label_by_min(len(f), a, b)
    least = {k: min((i for (i, _), c in zip(rows, label, strict=True) if c == k and i is not None), default=None) for k in set(label)}
    want = sorted(((i is None, i or 0), f"{x:016x}", least[c]) for (i, x), c in zip(rows, label, strict=True))
    got = simhash.simhash_components(df).collect()
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["fingerprint"], r["component_id"]) for r in got) == want


def test_op2_empty(odd):
    assert simhash.simhash_components(odd.limit(0)).count() == 0


def test_index_finds_all_components():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flip = lambda n: np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, n, replace=False).astype(np.uint64))
    f = np.unique(np.concatenate([base, [b ^ flip(k) for b in base for k in (1, 2, 3, 4, 5, 6)], [base[0] ^ flip(2) for _ in range(600)]]).astype(np.uint64))
    order = np.argsort(simhash.gray_rank(f))
    f = f[order]
    a, b, bits = simhash.Index(np.zeros(len(f), np.int64), f[:, None]).forest(np.arange(len(f)), len(f), 4)
    assert (np.bitwise_count(f[a] ^ f[b]) == bits).all() and (bits <= 4).all() and len(a) < len(f)
    x, y = np.nonzero(np.bitwise_count(f[:, None] ^ f[None]) <= 4)
    assert (label_by_min(len(f), a, b) == label_by_min(len(f), x, y)).all()


def test_index_with_buckets_of_all_sizes():
    rng = np.random.default_rng(8)
    size = [2, 3, 8, 9, 70, 2, 600, 1, 5]
    bucket = np.repeat(np.arange(len(size)), size)
    f = np.repeat(rng.integers(0, 2**63, len(size), dtype=np.uint64), size) ^ (np.uint64(1) << rng.integers(0, 64, len(bucket)).astype(np.uint64))
    order = np.lexsort([simhash.gray_rank(f), bucket])
    a, b, _ = simhash.Index(bucket[order], f[order][:, None]).forest(np.arange(len(f)), len(f), 4)
    assert len(a) == len(f) - len(size) and (bucket[order][a] == bucket[order][b]).all()


@pytest.mark.parametrize("n", [10, 10**6, 10**9, 10**13])
def test_block_sets_are_exact(n):
    sets, rng = simhash._block_sets(4, n), random.Random(n)
    for _ in range(300):
        diff = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(diff & m == 0 for m in sets)


def test_components(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 400)] + [(rng.randint(2000, 2200), rng.randint(2000, 2200)) for _ in range(150)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    at = {x: k for k, x in enumerate(nodes)}
    own = [(at[a], at[b]) for a, b in edges if a != b]
    label = label_by_min(len(nodes), *(np.array(x) for x in zip(*own, strict=True)))
    assert got == {x: nodes[label[at[x]]] for x in nodes}


def near_copies():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    texts, groups = [], []
    for g in range(30):
        base = [word() for _ in range(rng.choice([12, 60, 300, 900]))]
        texts.append(" ".join(base))
        groups.append(g)
        for _ in range(rng.choice([0, 0, 1, 4, 20])):
            own = base[:]
            for _ in range(len(own) // 150):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own))
            groups.append(g)
    return texts, groups


def test_without_copies(spark):
    texts, groups = near_copies()
    rows = [(k + 10, t, "x", g) for k, (t, g) in enumerate(zip(texts, groups, strict=True))] + [(10, texts[0], "x", groups[0]), (None, texts[0], "x", groups[0]), (None, "quite another text of its own", "x", 99), (None, "quite another text of its own", "x", 99)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, g long")
    kept = simhash.without_copies(df)
    assert kept.schema == df.schema
    sets = [{tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    alike = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    label = label_by_min(len(texts), *(np.array(x) for x in zip(*alike, strict=True)))
    got = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert got == sorted({int(c) + 10 for c in label})
    assert kept.where("doc_id is null").count() == 1
    assert simhash.without_copies(df.limit(0)).count() == 0


def removed(rows, least):
    first, out = {}, []
    rows = sorted(((i is None, i or 0, (t or "").encode()) for i, t in rows))
    for n, i, b in rows:
        for k in range(len(b) - least + 1):
            first.setdefault(b[k : k + least], (n, i))
    for n, i, b in rows:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - least + 1):
            if first[b[k : k + least]] < (n, i):
                gone[k : k + least] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((n, i, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_cover():
    assert {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER} == set(range(substrings.PERIOD))


@pytest.mark.parametrize("chunk", [3_000, 40_000, 10**9])
@pytest.mark.parametrize("least", [38, 50])
def test_op5(spark, monkeypatch, chunk, least):
    monkeypatch.setattr(substrings, "CHUNK", chunk)
    monkeypatch.setattr(substrings, "RANGE", max(1500, chunk // 2))
    monkeypatch.setattr(substrings, "PART", max(700, chunk // 4))
    rng = random.Random(chunk + least)
    share = ["".join(rng.choice("abcé ") for _ in range(n)) for n in (30, 49, 50, 51, 80, 300)]
    rows = [(k, "".join(rng.choice(share) if rng.random() < 0.4 else "".join(rng.choice("xyzß🙂") for _ in range(rng.randint(1, 90))) for _ in range(rng.randint(0, 8)))) for k in range(60)]
    rows += [(3, rows[5][1]), (70, rows[1][1]), (71, rows[1][1]), (None, rows[2][1]), (None, None), (80, ""), (81, "q" * 2000), (82, "q" * 700), (2, rows[2][1])]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_bytes int").repartition(3)
    got = substrings.remove_repeats(df, least).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == removed(rows, least)
    texts = substrings.remove_repeats(df, least, rewrite=True)
    assert texts.schema.names == df.schema.names and texts.count() == len(rows)


def test_op5_many_rows_of_one_id(spark, monkeypatch):
    """Rows without id, and of one id, for several chunks: none removes from its own kind, all from larger ids and by smaller ones; one large group of copies."""
    monkeypatch.setattr(substrings, "CHUNK", 3000)
    monkeypatch.setattr(substrings, "RANGE", 4000)
    monkeypatch.setattr(substrings, "PART", 1000)
    monkeypatch.setattr(substrings, "ANCHORS", 16)
    rng = random.Random(5)
    share = ["".join(rng.choice("abcd ") for _ in range(90)) for _ in range(6)]
    text = lambda: "".join(rng.choice(share) if rng.random() < 0.4 else "".join(rng.choice("xyz") for _ in range(60)) for _ in range(4))
    rows = [(k, text()) for k in range(60)] + [(None, text()) for _ in range(60)] + [(30, text()) for _ in range(60)] + [(k, rows_text) for rows_text in [text()] for k in range(100, 140)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    cuts = substrings.cut(df.select(F.coalesce("doc_id", F.lit(substrings.LAST)).alias("id"), F.col("text").cast("binary").alias("text")))
    assert cuts.alone.sum() == 2 and (cuts.chunks[cuts.alone] > 2).all() and cuts.chunks.sum() > 12
    ids = np.array(sorted({substrings.LAST if i is None else i for i, _ in rows}))
    rank = cuts.rank(cuts.of(ids, ids))
    assert (np.diff(rank) >= 0).all() and len(set(rank.tolist())) > 8
    got = substrings.remove_repeats(df, 50).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == removed(rows, 50)


@pytest.mark.parametrize("ids", [[0], [5] * 9, list(range(-40, 40)), [-(2**62), 0, 2**62], list(range(0, 10**6, 997))])
def test_chunks_are_in_the_order_of_ids(spark, monkeypatch, ids):
    monkeypatch.setattr(substrings, "CHUNK", 50)
    monkeypatch.setattr(substrings, "ANCHORS", 8)
    df = spark.createDataFrame([(i, bytearray(b"x" * 20)) for i in ids], "id long, text binary")
    cuts = substrings.cut(df)
    x = np.array(sorted(ids), np.int64)
    rank = cuts.rank(cuts.of(x, np.arange(len(x))))
    assert (np.diff(rank) >= 0).all() and (cuts.of(x, x) < cuts.chunks.sum()).all() and (cuts.of(x, x) >= 0).all()


def test_op5_empty(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 15, 900])
def test_op8(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(0, 1, (n, 12)).astype(np.float32).round(2)
    if n > 100:
        x[100:160] = x[7]  # many equal vectors
        x[200:210] *= 5
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)] + [(10_000, None, 1), (10_020, [0.0] * 12, 1), (10_040, [float("nan")] + [1.0] * 11, 1), (None, [1.0] * 12, 1), (10_060, [], 1), (10_080, [None] + [1.0] * 11, 1)]
    if n > 20:
        rows.append(rows[20])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int").repartition(3)
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, 20, ann.Settings(block=300)).collect()
    hits = total = 0
    y = x.astype(np.float64)
    for q in range(0, n, 20):
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        s = (y * y[q]).sum(1)
        assert [r["rank"] for r in own] == list(range(1, min(20, n - 1) + 1))
        assert all(abs(r["score"] - s[r["vec_id"]]) < 1e-9 and r["vec_id"] != q for r in own)
        assert [(-r["score"], r["vec_id"]) for r in own] == sorted((-r["score"], r["vec_id"]) for r in own)
        order = [k for k in np.lexsort([np.arange(n), -s]) if k != q][:20]
        hits, total = hits + len({r["vec_id"] for r in own} & set(order)), total + len(order)
    assert {r["query_id"] for r in got} == ({k for k in range(0, n, 20)} if n > 1 else set())
    assert hits >= 0.9 * total


def _units(rng, shape):
    x = rng.standard_normal(shape)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("kind, touched, verified", [("even", 0.15, 0.95), ("clusters", 0.08, 0.3)])
def test_op8_prunes(kind, touched, verified):
    """The share of the lines' entries that fall into windows, and of the rows that are verified, on vectors without any structure and on vectors in clusters."""
    rng = np.random.default_rng(0)
    x = _units(rng, (16_384, 64)) if kind == "even" else _units(rng, (200, 64))[rng.integers(200, size=16_384)] + 0.05 * rng.standard_normal((16_384, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s, q = ann.Settings(), np.arange(0, 16_384, 256)
    block = ann.Block(np.arange(len(x)), x, float(np.linalg.norm(x, axis=1).max()), s)
    got = list(block.search(q, x[q], 20))
    score = x[q] @ x.T
    score[np.arange(len(q)), q] = -np.inf
    best = np.argsort(-score, axis=1)[:, :20]
    assert np.mean([len(set(own) & set(want)) / 20 for (own, _), want in zip(got, best.tolist(), strict=True)]) > 0.93
    assert block.touched < touched * block.entries and block.verified < verified * block.rows


def test_op8_skips_blocks(spark):
    """Clusters far from each other stand in cells of their own: queries go to few of them; one vector that is a third of all rows is split."""
    rng = np.random.default_rng(1)
    x = (_units(rng, (16, 24))[np.arange(3000) % 16] + 0.01 * rng.standard_normal((3000, 24))).round(3)
    x[:1000] = x[0]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    s = ann.Settings(block=128)
    sent = []
    routed = ann._routed

    def counted(*args):
        run = routed(*args)
        sent.append(args[1])
        return run

    ann._routed = counted
    try:
        rows = ann.nearest(df, F.col("vec_id") % 20 == 0, 5, s)
        got = {(r["query_id"], r["rank"]): r["score"] for r in rows.collect()}
    finally:
        ann._routed = routed
    blocks = sum(int(subs.sum()) for own in sent[0].values() for _, _, subs, _, _ in own)
    assert blocks > 20
    plan = rows._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan
    right = 0
    for q in range(0, 3000, 20):
        score = (x * x[q]).sum(1)
        score[q] = -np.inf
        right += sum(abs(got[q, k + 1] - v) < 1e-9 for k, v in enumerate(np.sort(score)[::-1][:5]))
    assert right > 0.93 * 150 * 5


def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids, columns = {r[0] for r in docs.select("doc_id").collect()}, docs.columns
    for name, stage in cp.STAGES[:-1]:
        out = docs = stored(stage(spark, docs, SF), name)
        assert out.columns == columns, name
        got = {r[0] for r in out.select("doc_id").collect()}
        assert got <= ids and len(got) == out.count()
        ids = got
    assert cp.run(spark, SF).select("doc_id").distinct().count() > 100
