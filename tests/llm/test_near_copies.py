"""Near copies by brute force: pairs just over the limit, repeated shingles, dense groups under it."""

import itertools
import random

import numpy as np

from veilscan.llm import simhash
from veilscan.llm.common import label_by_min


def words(rng, n):
    return ["".join(rng.choice("abcdefghijkl") for _ in range(7)) for _ in range(n)]


def left(texts):
    sets = [{tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    alike = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    label = label_by_min(len(texts), *(np.array(x) for x in zip(*alike, strict=True))) if alike else np.arange(len(texts))
    return {int(x) for x in label}


def kept(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"] for r in simhash.without_copies(df).select("doc_id").collect()}


def test_pairs_just_over_the_limit(spark):
    rng, texts = random.Random(1), []
    for k in range(600):
        n = rng.choice([40, 100, 300])
        own = words(rng, n)
        new = round((n - 4) * (1 - 2 * 0.8 / 1.8)) - k % 2  # so many shingles less in common: a similarity from 0.80 on
        texts += [" ".join(own), " ".join(own[: n - new] + words(rng, new))]
    want = left_pairs(texts)
    assert len(want) < len(texts)
    assert kept(spark, texts) == want


def left_pairs(texts):
    """As left(), of texts that resemble their neighbour alone."""
    return {2 * k + x for k in range(len(texts) // 2) for x in left(texts[2 * k : 2 * k + 2])}


def test_repeats_within_a_text_do_not_count(spark):
    rng, texts = random.Random(2), []
    for _ in range(5):
        own, line = words(rng, 1000), words(rng, 12)
        texts += [" ".join(own + line), " ".join(own + line * 20)]
        phrase = words(rng, 5)
        texts += [" ".join(x for y in words(rng, 40) for x in [y, *phrase * 30]) for _ in range(2)]
    want = left(texts)
    assert {0, 4, 8} <= want and not {1, 5, 9} & want and {2, 3, 6, 7} <= want
    assert kept(spark, texts) == want


def test_dense_groups_under_the_limit(spark):
    rng, texts = random.Random(3), []
    for _ in range(3):
        base = words(rng, 200)
        for _ in range(60):
            own = base[:]
            for at in rng.sample(range(200), rng.choice([2, 4, 6])):
                own[at] = words(rng, 1)[0]
            texts.append(" ".join(own))
    want = left(texts)
    assert len(want) > 3
    assert kept(spark, texts) == want
