"""Encoding, packing, rules, classifier, licenses, html, language model: against brute force, libraries or held-out rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers as P
import zstandard
from pyspark.sql import functions as F

from tests.conftest import SF
from veilscan.llm import bpe, html_extract, licenses, lm_score, packing, quality_model, quality_rules
from veilscan.llm import queries as Q

#: Nulls, empty and very long texts, repeated rows, odd white space, a column whose name clashes with results.
ODD = [(1, None, 5), (2, "", 5), (3, "a" * 200_000, 5), (4, "Same text here, twice over.", 5), (4, "Same text here, twice over.", 5), (5, "  x \x1c\x85 y\n\n z  ", 5), (6, "日本語 🙂🙂 é́", 5), (None, "no id at all", 5), (7, " \n\t ", 5), (8, "w " * 30_000, 5)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, score int")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def multi():
    import tiktoken

    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    return ranks, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_transducer_like_library(multi):
    ranks, ref = multi
    enc, rng = bpe.Encoder(ranks, P.PATTERN), random.Random(1)
    bits = ["ab", "abc ", "  ", "\n", " \n", "aaaa", "the", "日本", "é", "🙂", "1", "22", "'s", "\x1c", "\x85", "\xa0", "$$", "of", "tion", " ", "\t", "́", "٣"]
    for _ in range(3000):
        x = "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))
        assert enc.encode(x).tolist() == ref.encode_ordinary(x), repr(x)
    for x in ("a" * 20_000, "ab" * 9000 + " " * 5000 + "b!" * 3000):
        assert enc.encode(x).tolist() == ref.encode_ordinary(x)


def test_transducer_in_chunks_and_after_reset(multi):
    ranks, ref = multi
    t = bpe.Transducer(ranks, states=50)
    for w in ("internationalization", "überraschung", "abababababab") * 3:
        assert t.encode(w.encode()) == ref.encode_ordinary(w)
    long = b"abcabd" * 3000
    assert [x for part in t.stream([long[k : k + 100] for k in range(0, len(long), 100)]) for x in part] == ref.encode_ordinary(long.decode())


def test_decoder(multi):
    ranks, ref = multi
    d = bpe.Decoder(ranks)
    ids = ref.encode_ordinary("日本語 🙂 é text")
    assert "".join(d.feed([i]) for i in ids) == "日本語 🙂 é text" and d.finish()
    d.reset()
    assert d.feed([ranks[b"\xf0"]]) == "" and not d.finish()
    for bad in ([b"\x80"], [b"\xc0", b"\x80"], [b"\xed", b"\xa0"], [b"\xf4", b"\x90"]):
        d.reset()
        with pytest.raises(ValueError):
            d.feed([ranks[b] for b in bad])


def test_op1(spark, multi, odd, none):
    ref = multi[1]
    got = bpe.encode_texts(odd, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, ids=True).collect()
    assert len(got) == len(ODD)
    for r, (i, text, _) in zip(sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"], r["n_tokens"])), sorted(ODD, key=lambda x: (x[0] is None, x[0])), strict=True):
        ids = ref.encode_ordinary(text or "")
        assert (r["doc_id"], r["n_tokens"], r["ids_sha256"]) == (i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest() and r["valid_utf8"] and list(r["ids"]) == ids
    back = bpe.decode_ids(bpe.encode_texts(odd, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, ids=True), P.path("byte_bpe_multi_50k.tiktoken"))
    assert sorted(r["text"] for r in back.collect()) == sorted(t or "" for _, t, _ in ODD)
    assert bpe.encode_texts(none, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0


def check_packed(rows, ref):
    """rows: op3's; ref: doc_id -> list of id arrays."""
    seqs, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append(r)
        docs[r["doc_id"]].append(r)
    for s in seqs.values():
        s.sort(key=lambda r: r["offset"])
        total = sum(r["length"] for r in s)
        assert [r["offset"] for r in s] == np.cumsum([0, *(r["length"] for r in s[:-1])]).tolist()
        assert total <= 2048 and (total == 2048 or total & (total - 1) == 0)
    for i, pieces in docs.items():
        assert sum(r["length"] for r in pieces) == sum(map(len, ref[i]))
        if len(ref[i]) == 1:
            at = 0
            for r in sorted(pieces, key=lambda r: r["start"]):
                assert (r["start"], r["doc_tokens"]) == (at, len(ref[i][0])) and r["ids_crc32"] == zlib.crc32(ref[i][0][at : at + r["length"]].tobytes())
                at += r["length"]
    assert set(docs) == set(ref)


def test_op3(spark, docs, odd, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    special = spark.createDataFrame([(900, "a<|endoftext|>b", 1)], odd.schema)
    for df in (docs, odd.union(special)):
        ref = defaultdict(list)
        for r in df.collect():
            ref[r["doc_id"]].append(np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4"))
        check_packed(packing.pack_texts(df, packing.encode_with(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, 1)).collect(), ref)
    assert packing.pack_texts(none, packing.encode_with(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, 1)).count() == 0


@pytest.mark.parametrize("limits", [packing.Limits(64, 5, 40, 16), packing.Limits(128, 3, 128, 8), packing.Limits(64, 64, 20, 4)])
def test_pack_limits(limits):
    rng = random.Random(3)
    examples = [(k, n := rng.choice([1, 2, 3, 10, 50, 64, 200]), rng.randint(0, n)) for k in range(400)]
    seen, quiet = defaultdict(list), {k: q for k, _, q in examples}
    padding = 0
    for seq in packing.pack(iter(examples), limits):
        n = sum(p[2] for p in seq)
        loss = sum(max(0, s + m - max(s, quiet[k])) for k, s, m in seq)
        assert n <= limits.tokens and len(seq) <= limits.segments and loss <= limits.loss_tokens
        padding += 0 if n & (n - 1) == 0 else limits.tokens - n
        for k, s, m in seq:
            seen[k] += range(s, s + m)
    assert padding == 0 and all(sorted(seen[k]) == list(range(n)) for k, n, _ in examples)


def rule_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = defaultdict(list)
    for k in range(len(words) - 7):
        windows[tuple(words[k : k + 8])].append(k)
    rep = {j for at in windows.values() if len(at) > 1 for k in at for j in range(k, k + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(rep)


def test_op7(spark, docs, labels, odd, none):
    for df in (docs, odd):
        got = sorted(map(tuple, quality_rules.quality_rules(df, labels).select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()))
        want = sorted((*s, s[0] < 20 or 100 * s[4] > 30 * s[0]) for s in (rule_stats(r["text"]) for r in df.collect()))
        assert got == want
    rows = quality_rules.quality_rules(docs, labels).join(labels, "doc_id").toPandas()
    fine = rows[(rows.quality == 1) & ~rows.base_failed]
    assert fine.kept.mean() > 0.97 and rows[rows.quality == 0].kept.mean() < 0.3 and not rows[rows.base_failed].kept.any()
    kept = quality_rules.passing(docs, labels)
    assert kept.schema == docs.schema and kept.count() == quality_rules.quality_rules(docs, labels).where("kept").count()
    assert quality_rules.quality_rules(none, labels).count() == 0 and quality_rules.quality_rules(odd, labels.limit(0)).count() == len(ODD)


def test_op7_on_held_out_labels(spark):
    """The forest and its limit from half of the labelled rows, judged on the other half."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_rules.quality_rules(docs, labels, keep=lambda i: F.crc32(i.cast("string").cast("binary")) % 2 == 0).join(labels, "doc_id").toPandas()
    rows = rows[rows.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 2 == 1) & ~rows.base_failed]
    assert rows[rows.quality == 1].kept.mean() > 0.99 and rows[rows.quality == 0].kept.mean() < 0.05, rows.groupby("quality").kept.agg(["mean", "size"])
    print(rows.groupby("quality").kept.agg(["mean", "size"]))


def test_forest_isolates():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 0.01, (2000, len(quality_rules.FEATURES)))
    f = quality_rules.Forest(x)
    far = x[:5].copy()
    far[:, 1] += 2.0
    assert f.score(far).min() > f.score(x).max()


def test_quality_rules_fit_all_labelled_rows(spark):
    """The limit is a quantile of all labelled good rows, and each of them is in a tree."""
    rng, n = random.Random(5), 9000
    rows = [(k, " ".join("ab#!|T"[rng.randrange(6)] * rng.randint(1, 9) + str(rng.randrange(40)) for _ in range(rng.randint(21, 40)))) for k in range(n)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.range(n).selectExpr("id as doc_id", "1 as quality")
    got = quality_rules.quality_rules(docs, labels, lose=0.05).toPandas()
    ok = got[~got.base_failed]
    assert len(ok) > 8500 and (ok.kept == (ok.anomaly <= np.quantile(ok.anomaly, 0.95) + 1e-12)).all()
    f = spark.range(n).selectExpr("id as doc_id", "array(0D) as f")
    for sample in (512, 8):
        d = quality_rules.dealt(f, n, sample, 7).toPandas()
        assert set(d.doc_id) == set(range(n)) and not d.duplicated(["tree", "doc_id"]).any() and d.tree.nunique() == quality_rules.TREES


def test_op4(spark, docs, labels, odd, none):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality_model.quality_scores(big, lab).toPandas()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all() and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    out = got[got.held_out].merge(lab.toPandas(), on="doc_id")
    assert (out.predicted == out.quality).mean() > 0.95
    # labels of held-out rows don't matter
    turned = lab.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")).cast("int"))
    assert quality_model.quality_scores(big, turned).toPandas().sort_values("doc_id").score.tolist() == got.sort_values("doc_id").score.tolist()
    few = quality_model.quality_scores(odd, labels)
    assert few.count() == len(ODD) and few.where("score is null").count() == 0 and quality_model.quality_scores(none, labels).count() == 0
    assert quality_model.quality_scores(odd, labels.limit(0)).select("score").distinct().first()[0] == 0.5


def test_op4_brute_force(spark):
    """Scores made anew from the rows at hand, with zstandard alone."""
    import zstandard

    texts = [(k, ("good words of a calm text number %d " % k) * (3 + k % 5) + "x y " * 9000 * (k == 4), 1) for k in range(20)] + [(100 + k, "BUY!!! cheap $$$ now %d " % k * (2 + k % 4), 0) for k in range(20)]
    rows = [*texts, (200, None, None), (201, "", None), (202, "some other words", None)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows if q is not None] * 2, "doc_id long, quality int, toxic int")
    learn = [(i, t.encode(), q) for i, t, q in texts if zlib.crc32(str(i).encode()) % 4 != 2]
    cut = lambda t: [t[k : k + 2048] for k in range(0, len(t), 2048)]
    part = lambda q, third: [t for k, (_, t) in enumerate(sorted((i, t) for i, t, x in learn if x == q)) if (k % 3 == 0) == third]

    def dictionary(q):
        parts = [p for c in map(cut, part(q, False)) for p in (c if len(c) <= 16 else [c[k * (len(c) - 1) // 15] for k in range(16)])]
        try:
            return zstandard.train_dictionary(65536, parts, level=3).as_bytes()
        except zstandard.ZstdError:
            return b"".join(parts)[-65536:]

    plain = {"level": 3, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    dicts = [zstandard.ZstdCompressionDict(dictionary(q)) for q in (1, 0)]

    def x(t):
        good, bad = (sum(len(zstandard.ZstdCompressor(dict_data=d, **plain).compress(p)) for p in cut(t)) for d in dicts)
        return [(bad - good) / max(len(t), 1), good / max(len(t), 1), sum(len(zstandard.ZstdCompressor(**plain).compress(p)) for p in cut(t)) / max(len(t), 1)]

    m = np.array([x(t) for q in (0, 1) for t in part(q, True)])
    y = np.array([q for q in (0, 1) for _ in part(q, True)], float)
    z = np.c_[(m - m.mean(0)) / (m.std(0) + 1e-9), np.ones(len(m))]
    w = np.zeros(4)
    for _ in range(2000):  # the ridge's optimum, by small steps of another kind
        p = 1 / (1 + np.exp(-z @ w))
        w += np.linalg.solve(z.T @ z / 4 + 0.05 * np.eye(4), z.T @ (y - p) - 0.05 * w)
    score = lambda t: 1 / (1 + math.exp(-float(np.r_[(np.array(x(t)) - m.mean(0)) / (m.std(0) + 1e-9), 1] @ w)))
    got = {r["doc_id"]: r["score"] for r in quality_model.quality_scores(docs, labels).collect()}
    assert all(math.isclose(got[i], score((t or "").encode()), rel_tol=1e-4, abs_tol=1e-6) for i, t, _ in rows)


def test_labelled_rows_that_repeat(spark):
    """A labelled id in thousands of rows is one labelled document."""
    from veilscan.llm.common import labelled_sample

    docs = spark.createDataFrame([(1, f"text {k}") for k in range(3000)] + [(2, None), (3, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0), (3, 1), (4, 1), (None, 1)], "doc_id long, quality int")
    assert sorted((r["doc_id"], r["quality"]) for r in labelled_sample(docs, labels, 10).collect()) == [(1, 1), (2, 0)]


def test_op9(spark, odd, none):
    mit = dict(licenses.KNOWN[:1])["MIT"]
    british = mit.replace("sublicense", "sublicence").replace("MIT License", "The MIT").replace("The MIT", "MIT Licence")
    rows = [(1, "Copyright (c) 2020 Somebody\n\n" + mit.upper()), (2, "  " + british.replace(" ", "\n   ")), (3, mit + " more"), (4, "text\nLicensed under the Apache licence, version 2.0\nend"), (5, None)]
    got = {r["doc_id"]: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["license_id"] == got[2]["license_id"] == "MIT" and got[3]["license_id"] is None and got[4]["notices"] == "Apache-2.0" and got[5]["n_canonical"] == 0
    assert licenses.license_scan(odd).count() == len(ODD) and licenses.license_scan(none).count() == 0
    assert licenses.license_scan(odd, known=()).count() == len(ODD)
    plan = licenses.license_scan(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_op9_finds_every_known_text_inside_a_document(spark):
    """Each known text stands between other lines, its own lines broken anew; twice in one document; cut short, it is not found."""
    known = licenses.known_texts()
    short = len(licenses.KNOWN)
    wrap = lambda k, t: re.sub(r"((?:\S+\s+){7})", lambda m: m[1].rstrip() + "\n", t) if k < short else re.sub(r"(?m)^", " *   ", t)
    rows = [(k, f"Some words before.\nA line of its own\n{wrap(k, t)}\nand a line after it.") for k, (_, t) in enumerate(known)]
    rows += [(1000 + k, "first " + " ".join(t.split()[:-2])) for k, (_, t) in enumerate(known[:6])] + [(2000, known[0][1] + "\n\n" + known[1][1] + "\n" + known[0][1])]
    got = {r["doc_id"]: r["notices"].split(",") for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(i in got[k] for k, (i, _) in enumerate(known)), [i for k, (i, _) in enumerate(known) if i not in got[k]]
    assert all(known[k][0] not in got[1000 + k] for k in range(6)) and {"MIT", "ISC"} <= set(got[2000])


def test_op9_forms_agree(spark):
    texts = [t for _, t in licenses.known_texts()] + ["Copyright (c) 2020 A\n(C) 1999 b\nWhilst ©\n v2 é É", ""]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, text string").select("k", licenses.canonical(F.col("text")).alias("form")).collect()
    assert all(r["form"] == licenses.canonical_form(texts[r["k"]]) for r in got)


def test_op9_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    want = sorted(map(str, con.execute(licenses.license_sql()).fetchall()))
    got = Q.op9_license_scan(spark, sf).select("doc_id", "digest", "n_canonical", "license_id", "notices").collect()
    assert sorted(str(tuple(r)) for r in got) == want


PAGES = [
    ("<html><body><nav><a href=/>Home</a></nav><div class=ad>Buy</div><article><h1>T &amp; t</h1><p>one<br>two<p>th<b>re</b>e</article><footer>f</footer></body></html>", "T & t one two three"),
    ("<body><header><h1>Site</h1></header><main><p>Some text of the page, with words.</p><aside>Related things you may like to read as well</aside><form><p>Name please</p></form></main><div class='cookie-notice'>We use cookies on this site, do agree</div>", "Some text of the page, with words."),
    ("<article><p>Read this</p><div id=comments><p>I liked this article very much, thank you for it</p></div></article>", "Read this"),
    ("<article>a<!-- x > y --><script>if (a < b) '</p>'</script><style>p{}</style>b</article><!-- open <p>c", "ab"),
    ("<div class='post-content'><p>Intro words here</p><div class='share'>Share it</div><ul><li>x</li><li>y</li></ul></div><section role=complementary>More</section>", "Intro words here x y"),
    ("<div>Some words that stand before the story, in no element of their own.</div><article><p>Story.</p></article><div> <span class=promo>Buy it</span></div><button>Send</button>", "Story."),
    ("", ""), (None, ""), ("<p>   </p>", ""), ("plain text without any tags at all in here", "plain text without any tags at all in here"),
    ("<article><p title='a > b'>q&#233;&nbsp;&eacute;</p>\n\t<p>z</p></article>", "qé é z"),
]


def test_op6(spark):
    rows = [(k, f"u{k}", h, "x") for k, (h, _) in enumerate(PAGES)] + [(0, "u0", PAGES[0][0], "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_extract.extract_pages(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["text"] == PAGES[r["page_id"]][1] and r["n_chars"] == len(r["text"])
    assert html_extract.extract_pages(df.limit(0)).count() == 0
    assert html_extract.main_text("<div>" * 3000 + "deep text" + "</div>" * 3000) is not None


def test_op6_articles(spark, sf):
    import html

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in Q.op6_html_text(spark, sf).collect():
        m = re.search(r"<article>(.*?)(</article>|<footer>|\Z)", pages[r["page_id"]], re.S)[1]
        assert r["text"] == " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br|li|ul)>", " ", m))).split())


def _flow(parent, lean, tie, next_tie):
    """The maximum flow of the same graph, by shortest augmenting paths."""
    n = len(parent)
    room = defaultdict(float)
    for k in range(n):
        room["s", k] += max(lean[k], 0)
        room[k, "t"] += max(-lean[k], 0)
        if k:
            room[k, parent[k]] += tie[k]
            room[parent[k], k] += tie[k]
    for p in range(n):
        own = [k for k in range(1, n) if parent[k] == p]
        for x, y in zip(own, own[1:]):
            room[x, y] += next_tie
            room[y, x] += next_tie
    total = 0.0
    while True:
        came, todo = {"s": None}, ["s"]
        for u in todo:
            for v in [*range(n), "t"]:
                if v not in came and room[u, v] > 1e-9:
                    came[v] = u
                    todo.append(v)
        if "t" not in came:
            return total
        path, v = [], "t"
        while came[v] is not None:
            path.append((came[v], v))
            v = came[v]
        least = min(room[e] for e in path)
        for u, v in path:
            room[u, v] -= least
            room[v, u] += least
        total += least


def test_min_cut():
    """Against all labellings, and its size against the maximum flow."""
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(1, 9)
        parent = [-1] + [rng.randrange(k) for k in range(1, n)]
        lean = [rng.choice([rng.uniform(-3, 3), 0.0, 2.0, -2.0]) for _ in range(n)]
        tie = [rng.uniform(0, 2) for _ in range(n)]
        own = [[k for k in range(1, n) if parent[k] == p] for p in range(n)]

        def cost(x):
            own_cost = sum(max(-v, 0) if keep else max(v, 0) for v, keep in zip(lean, x))
            return own_cost + sum(tie[k] for k in range(1, n) if x[k] != x[parent[k]]) + sum(0.5 for c in own for a, b in zip(c, c[1:]) if x[a] != x[b])

        best = min(cost([bool(m >> k & 1) for k in range(n)]) for m in range(2**n))
        got = cost(html_extract.min_cut(parent, lean, tie, 0.5))
        assert math.isclose(got, best, abs_tol=1e-9) and math.isclose(got, _flow(parent, lean, tie, 0.5), abs_tol=1e-6)


def test_op6_the_cut_decides(spark, sf):
    """Without the cut, by the blocks' own evidence alone, many blocks get another label, and the article is lost on most pages."""
    pages = [r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").select("html").collect()]
    w = html_extract.learn(spark.read.parquet(f"{sf}/pages.parquet"))
    turned = worse = 0
    for html in pages:
        texts, parent, lean, tie = html_extract.graph(html, w)
        keep = html_extract.min_cut(parent, lean, tie, html_extract.NEXT)
        own = [k for k, t in enumerate(texts) if t is not None]
        turned += sum(keep[k] != (lean[k] > 0) for k in own)
        worse += " ".join(texts[k] for k in own if lean[k] > 0) != html_extract.main_text(html, w)
    assert turned > len(pages) / 2 and worse > len(pages) / 2


def test_op6_learns_names(spark):
    """Names in no list are learned where HTML says what is content, and tell on pages where nothing else does."""
    line = "A line of some eight words stands in here."
    told = [f"<nav class=qq><p>{line}</p></nav><article><div class=zz><p>{line}</p><p>Short.</p></div></article><div class='rail9 qq'><p>{line}</p></div>"] * 300
    plain = f"<div class=zz><p>{line} One.</p><p>Short.</p></div><div class=rail9><p>{line} Two.</p></div>"
    pages = spark.createDataFrame([(k, "u", h) for k, h in enumerate([*told, plain])], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(pages).collect()}
    assert got[300] == f"{line} One. Short." and got[0] == f"{line} Short."
    alone = html_extract.extract_pages(pages.where("page_id = 300")).first()["text"]
    assert "Two." in alone  # nothing tells it there


def test_op6_long_and_deep_pages():
    import time

    big = "<article>" + "".join(f"<div class=ad>Buy {k} now</div><p>Some words that go on {k}.</p>" for k in range(4000)) + "</article>"
    at = time.process_time()
    text = html_extract.main_text(big)
    assert time.process_time() - at < 1 and text.startswith("Some words that go on 0. Some") and "Buy" not in text and text.count("go on") == 4000
    deep = "<div>" * 3000 + "<nav><b>x</nav>" + "<i>" * 3000 + "deep</i> text" + "</div>" * 2999 + "<aside hidden>no</aside></div><p>after"
    assert html_extract.main_text("<main>" + deep) == "deep text after"
    assert html_extract.main_text("<article>" + "<div>" * 600 + "<nav><p>menu words stand here</p></nav>" + "kept words of the article</article>") == "kept words of the article"


def test_op6_drops_nothing_of_an_article():
    tags = "math map object canvas audio video svg figure table".split()
    html = "<article>" + "".join(f"<p>before</p><{t}>in {t}</{t}>" for t in tags) + "<ul><li>x</li><li>y</li><li>z</li><li><a href=/>w</a></li></ul><p><a href=/>A link alone</a></p></article>"
    got = html_extract.main_text(html)
    assert all(f"in {t}" in got for t in tags) and got.endswith("x y z w A link alone")


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_op10(spark, docs, odd, which, monkeypatch):
    monkeypatch.setattr(lm_score, "CHUNK", 60_000)
    monkeypatch.setattr(lm_score, "RANGE", 20_000)
    df = {"docs": docs, "odd": odd}[which]
    rows = [(r["doc_id"], words(r["text"])) for r in df.collect()]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    count = Counter(w for i, ws in rows if not out(i) for w in ws)
    n_docs = sum(not out(i) for i, _ in rows)
    n, v = sum(count.values()) + n_docs, len(count) + 1
    want = sorted((i is None, i or 0, len(ws) + 1, sum(w in count for w in ws) + 1, n, round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws) + math.log10((n_docs + 0.5) / (n + 0.5 * (v + 1))), 4)) for i, ws in rows)
    got = lm_score.lm_scores(df.repartition(3), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["held_out"] == out(r["doc_id"]) and r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_op10_empty(none):
    assert lm_score.lm_scores(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_op10_beats_its_base(spark):
    """On held-out documents of the largest table the model gives more than the words alone; on small ones, where every fifth word is new, the base, which gives any new word
    as much as half an occurrence, is no distribution and hard to beat."""
    got = lm_score.lm_scores(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    r = got.where("held_out").agg(F.sum("base_score").alias("base"), F.sum("score").alias("own"), F.avg((F.col("score") > F.col("base_score")).cast("double")).alias("better")).first()
    assert r["own"] > 0.95 * r["base"] and r["better"] > 0.8


def test_tables_add_up_in_several_levels(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "STEP", 3)
    rng = np.random.default_rng(0)
    parts = [rng.integers(0, 3, (lm_score.TABLES * 10 + 1, 2)) for _ in range(20)]
    rows = [(k, "t", 0, lm_score._names(np.nonzero(x.any(1))[0]), lm_score._counts(x[x.any(1)])) for k, x in enumerate(parts)]
    sent = spark.createDataFrame([(*r[:3], bytearray(r[3]), bytearray(r[4])) for r in rows], lm_score.SENT)
    assert (lm_score._tables(sent, 20, 10, 2) == sum(parts)).all()


def _little_gate(tokens=40, experts=5):
    rng = np.random.default_rng(0)
    return lm_score.Gate.start(rng.integers(0, 30, (tokens, experts))), rng


def test_experts_are_distributions():
    """All words over a little alphabet of subwords: what is seen, and all chains up to some length, sum up to nearly one."""
    rng, k, v = np.random.default_rng(1), 3, 4
    opens, inside = rng.integers(0, 9, (v, k)), np.zeros((v, k), int)
    pairs = rng.integers(0, 2, (v, v, k))
    inside, before = pairs.sum(0), pairs.sum(1)
    stops = rng.integers(20, 60, (v, k))  # short words, so that long chains weigh nothing
    seen = {(0,): [3, 0, 1], (1, 2): [0, 2, 1]}
    counts = np.array(list(seen.values()))
    own = lm_score.Experts(counts.sum(0), (counts > 0).sum(0), np.array([1, 0, 2]), np.stack([opens, inside, before, stops]))
    chains = [(a,) for a in range(v)]
    words = list(chains)
    for _ in range(4):
        chains = [c + (a,) for c in chains for a in range(v)]
        words += chains
    ids, start = np.array([t for w in words for t in w]), np.cumsum([0, *map(len, words)])
    prev = np.r_[ids[:1], ids[:-1]]
    log = own.log_words(np.array([seen.get(w, [0] * k) for w in words]), own.spelling(ids, start, pairs[prev, ids]))
    total = np.exp(log.astype(float)).sum(0)
    assert (total < 1.0001).all() and (total > 0.99).all(), total


def test_gate_is_a_distribution_and_causal():
    gate, rng = _little_gate()
    ids, used, _ = lm_score.windows(rng.integers(0, 39, 200), np.array([70, 0, 130]), np.zeros(200, bool), 39)
    rows = np.nonzero(used[:4].reshape(-1))[0]
    share = gate.share(ids[:4], rows)
    assert np.allclose(share.sum(1), 1, atol=1e-5)
    later = ids[:4].copy()
    later[:, -1] = (later[:, -1] + 1) % 40  # the last input may change only the last position
    same = rows % lm_score.SCORED < lm_score.SCORED - 1
    assert np.allclose(share[same], gate.share(later, rows)[same], atol=1e-5)


def test_windows_take_each_place_once():
    size = np.array([0, 1, 23, 24, 25, 100])
    ids = np.concatenate([np.arange(n) for n in size])
    begins = ids % 3 == 0
    given, used, ask = lm_score.windows(ids, size, begins, 999)
    assert used.sum() == (size + 1).sum() and ask.sum() == begins.sum() + len(size)
    own = np.repeat(np.arange(len(size)), -(-(size + 1) // lm_score.SCORED))
    for k, n in enumerate(size.tolist()):
        assert given[own == k][:, lm_score.CONTEXT :].reshape(-1)[: n + 1].tolist() == [999, *range(n)]
        before = given[own == k][:, : lm_score.CONTEXT]
        assert (before[0] == 999).all() and all((before[j] == given[own == k][j - 1, -lm_score.CONTEXT :]).all() for j in range(1, len(before)))


def test_gradients():
    gate, rng = _little_gate()
    ids, used, _ = lm_score.windows(rng.integers(0, 39, 100), np.array([60, 40]), np.zeros(100, bool), 39)
    goal = rng.integers(0, 5, used.size)
    gate.w = {k: x.astype(np.float64) for k, x in gate.w.items()}
    _, g = gate.gradients(ids, goal, used)
    for name in ("c", "f", "g", "o", "q", "kv", "p", "e"):
        x = gate.w[name]
        rows, own = g[name] if name == "e" else (np.arange(len(x)), g[name])
        r, c = int(rng.integers(len(rows))), int(rng.integers(x.shape[1]))
        old, step = x[rows[r], c], 1e-4
        x[rows[r], c] = old + step
        up = gate.gradients(ids, goal, used)[0]
        x[rows[r], c] = old - step
        down = gate.gradients(ids, goal, used)[0]
        x[rows[r], c] = old
        assert math.isclose((up - down) / (2 * step), own[r, c], rel_tol=0.05, abs_tol=2e-5), name


def test_training_looks_at_every_position(spark, monkeypatch):
    """All words of the training documents are in the windows that the gate is trained on, and those of held-out ones in none."""
    monkeypatch.setattr(lm_score, "GROUP", 500)
    rng, path = random.Random(4), P.path("byte_bpe_50k.tiktoken")
    texts = [b" ".join(rng.choice(b"alpha beta gamma delta epsilon".split()) + str(rng.randrange(99)).encode() for _ in range(n)) for n in (1500, 0, 3, 700)]
    words, at, n = lm_score.numbered(iter(texts))
    row = {"chunk": [0], "ids": [[0, 1, 2, 3]], "learn": [[True, True, True, False]], "sizes": [n.tolist()], "words": [zstandard.compress(b" ".join(words))], "at": [lm_score._zip(at, "<u4")]}
    read = [b.to_pylist()[0] for b in lm_score._training(path, P.PATTERN, np.eye(2, lm_score.FEATURES, dtype=np.float32))(iter([pa.RecordBatch.from_pydict(row)]))]
    used = [lm_score._unzip(r["counts"], "u1").reshape(-1, lm_score.SCORED + 1)[:, 1:].astype(bool) for r in read]
    given = [lm_score._unzip(r["data"], "<u4").reshape(-1, lm_score.SPAN)[:, lm_score.CONTEXT :][u] for r, u in zip(read, used, strict=True)]
    sub = lm_score._subwords(path, P.PATTERN)
    want = [i for w in b" ".join([texts[0], texts[2]]).split() for i in sub.coder.encode_ordinary(" " + w.decode())]
    got = np.concatenate(given)
    assert len(read) >= 3 and got[got != sub.end].tolist() == want


def test_training_in_parts_lowers_the_loss(spark):
    """Two kinds of streams: after averaged rounds the gate tells them apart."""
    rng = np.random.default_rng(3)
    tokens = np.ones((40, 2), int)
    kind = rng.integers(0, 2, 200)
    streams = [rng.integers(0, 20, 30) + 15 * k for k in kind]
    rows = []
    for part in range(4):
        own = range(part, 200, 4)
        ids, used, _ = lm_score.windows(np.concatenate([streams[j] for j in own]), np.full(50, 30), np.zeros(1500, bool), 39)
        rows.append((part, lm_score._zip(ids, "<u4"), lm_score._zip(np.concatenate([np.repeat(kind[list(own)], 2)[:, None], used], 1), "u1")))
    kept = spark.createDataFrame([(bytearray(a), bytearray(b)) for _, a, b in rows], "data binary, counts binary").repartition(4)
    gate = lm_score.train_gate(kept, 4, tokens)
    before = lm_score.Gate.start(tokens).gradients(ids, np.repeat(np.repeat(kind[list(own)], 2), lm_score.SCORED), used)[0]
    assert gate.gradients(ids, np.repeat(np.repeat(kind[list(own)], 2), lm_score.SCORED), used)[0] < 0.9 * before
