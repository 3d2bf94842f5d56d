"""Quality rules: rule statistics of whole texts, base limits, and an isolation forest on the statistics.

The forest is grown on statistics of all labelled good rows, dealt to its trees; a document's score is 2 ** (-mean path length / expected length), near 1
for rows that random splits isolate early. The limit is calibrated from all labelled rows.

Defined results: null and empty texts have no words (base_failed); repeated rows get equal verdicts; rows with a null doc_id
are scored alike; extra columns are ignored; without labelled good rows the forest keeps all that pass the base limits."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, discard, labelled, stored

SYMBOLS = "#*$%&|<>"
BASE = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long")]
#: Ratios that the forest sees, and how far beyond the labelled rows' range its random cuts may fall: where labelled rows never go
#: (a text full of signs, say), a cut in this margin isolates a row early, although no labelled row shows it.
FEATURES = {"word_len": 1.0, "symbols": 0.5, "dup_lines": 0.1, "repeats": 0.1, "runs": 0.1, "marks": 0.3, "bars": 0.25, "top_word": 0.1, "upper": 0.15}
WINDOW = 8
#: Trees (a power of two), and the rows that a tree gets while there are no more good rows than TREES * SAMPLE; of more it gets its share of all.
TREES, SAMPLE = 256, 512
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(1)) * _ODD
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def repeat_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words in windows that occur twice or more. ids: a number for each word; windows are compared by a 64-bit polynomial of mixed ids."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    m, h = _mixed(ids.astype(np.uint64)), np.zeros(n, np.uint64)
    for k in range(window):
        h = h * np.uint64(0xD1342543DE82EF95) + m[k : k + n]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.nonzero(hit)[0]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str) -> tuple[tuple[int, int, int, int, int], list[float]]:
    """The five base statistics and the forest's features of one whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, chars = len(words), len(text) - sum(text.count(c) for c in ASCII_SPACE.decode())
    n_symbols = sum(raw.count(c.encode()) for c in SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x.strip(ASCII_SPACE)]
    dup = len(lines) - len(set(lines))
    first: dict[bytes, int] = {}
    ids = np.fromiter((first.setdefault(w, len(first)) for w in words), np.int64, n)
    rep = repeat_words(ids)
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    marks = sum(raw.count(c) for c in (b"!", b"?"))
    top = int(np.bincount(ids).max()) if n else 0
    w, c = max(n, 1), max(chars, 1)
    runs = int((ids[1:] == ids[:-1]).sum()) if n > 1 else 0
    features = [chars / w, n_symbols / w, dup / max(len(lines), 1), rep / w, runs / w, marks / w, raw.count(b"|") / w, top / w, upper / c]
    return (n, chars, n_symbols, dup, rep), features


def _margins() -> list[float]:
    return list(FEATURES.values())


def grown(rows: np.ndarray, depth: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One tree over all of its rows: axis, cut and path length of each node (the children of k are 2k and 2k + 1)."""
    rng, margin, size = np.random.default_rng(seed), _margins(), 2 ** (depth + 1)
    axis, cut, path = np.full(size, -1, np.int16), np.zeros(size), np.zeros(size)
    todo = [(1, 0, rows)]
    while todo:
        node, level, own = todo.pop()
        if level == depth or len(own) < 2:
            path[node] = level + Forest.expected(len(own))
            continue
        a = int(rng.integers(rows.shape[1]))
        c = rng.uniform(own[:, a].min() - margin[a], own[:, a].max() + margin[a])
        axis[node], cut[node] = a, c
        right = own[:, a] > c
        todo += [(2 * node, level + 1, own[~right]), (2 * node + 1, level + 1, own[right])]
    return axis, cut, path


class Forest:
    """Isolation forest as flat arrays; all rows and trees are followed at once, level by level."""

    def __init__(self, x: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = 7):
        rng, sample = np.random.default_rng(seed), min(sample, len(x))
        depth = self.levels(sample)
        self._hold([(sample, *grown(x[rng.choice(len(x), sample, replace=False)], depth, seed * trees + t)) for t in range(trees)], depth)

    @classmethod
    def of(cls, trees: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], depth: int) -> Forest:
        """A forest of grown trees, each with the number of its rows."""
        out = cls.__new__(cls)
        out._hold(trees, depth)
        return out

    def _hold(self, trees: list, depth: int) -> None:
        self.depth, self.usual = depth, max(float(np.mean([self.expected(n) for n, *_ in trees])), 1e-9)
        self.axis, self.cut, self.path = (np.stack(x) for x in list(zip(*trees, strict=True))[1:])

    @staticmethod
    def levels(sample: int) -> int:
        return max(1, int(np.ceil(np.log2(max(sample, 2)))))

    @staticmethod
    def expected(n: int) -> float:
        """Mean path length of an unsuccessful search among n."""
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for axis, cut, path in zip(self.axis, self.cut, self.path, strict=True):
            node = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                a = axis[node]
                inner = a >= 0
                node = np.where(inner, 2 * node + (x[rows, np.maximum(a, 0)] > cut[node]), node)
            total += path[node]
        return 2.0 ** (-total / len(self.axis) / self.usual)


SCHEMA = "doc_id long, " + ", ".join(f"{k} {t}" for k, t in BASE) + ", f array<double>"


def _measured(it):
    for b in it:
        rows = [measure(x.as_py() or "") for x in b.column(1)]
        cols = {"doc_id": b.column(0)} | {k: pa.array([r[0][i] for r in rows], pa.int64()) for i, (k, _) in enumerate(BASE)}
        yield pa.RecordBatch.from_pydict(cols | {"f": pa.array([r[1] for r in rows], pa.list_(pa.float64())), "key": b.column(2)})


def measured(docs: DataFrame) -> DataFrame:
    """The statistics of every document, stored: some numbers a row, so that no text is shuffled or read twice. key: a hash of the text."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key"))
    return stored(own.mapInArrow(_measured, SCHEMA + ", key long"), "measured")


def base_failed(n_words, n_repeat_words):
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


def dealt(good: DataFrame, n: int, sample: int, seed: int) -> DataFrame:
    """tree, doc_id, f: every one of the n good rows goes to one tree at least, and to as many as give a tree `sample` rows; of more rows than that takes, each tree gets its
    share. A row goes from a hashed tree in steps of a hashed odd number, so that two trees share rows by chance alone."""
    copies, h = min(TREES, math.ceil(TREES * sample / n)), F.xxhash64("doc_id", F.lit(seed))
    step = F.pmod(F.shiftrightunsigned(h, 8), F.lit(TREES)).bitwiseOR(F.lit(1))
    trees = F.transform(F.sequence(F.lit(0), F.lit(copies - 1)), lambda k: F.pmod(F.pmod(h, F.lit(TREES)) + k * step, F.lit(TREES)).cast("int"))
    return good.select(F.explode(trees).alias("tree"), "doc_id", "f")


def _features(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.array(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), len(FEATURES))


def _grower(depth: int, seed: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("doc_id")
        tree = t.column("tree")[0].as_py()
        parts = grown(_features(t.column("f")), depth, seed * TREES + tree)
        return pa.table({"tree": pa.array([tree], pa.int32()), "n": pa.array([t.num_rows], pa.int64())} | {k: pa.array([x.tobytes()], pa.binary()) for k, x in zip(("axis", "cut", "path"), parts, strict=True)})

    return run


def _quantile(scores: DataFrame, n: int, p: float) -> float:
    """The quantile of the n scores, exactly: only those beyond it are brought to the driver, from the nearer end."""
    at = p * (n - 1)
    low = min(int(at), max(n - 2, 0))
    end = scores.orderBy(F.asc("anomaly") if p < 0.5 else F.desc("anomaly")).limit(low + 2 if p < 0.5 else n - low)
    got = np.sort([r["anomaly"] for r in end.collect()])
    a, b = (got[low : low + 2] if p < 0.5 else got[:2])[[0, -1]]
    return float(a + (at - low) * (b - a))


def fit(rows: DataFrame, labels: DataFrame, lose: float = 0.001, sample: int = SAMPLE, seed: int = 7, keep=None) -> tuple[Forest | None, float]:
    """The forest and its limit, from every labelled row of measured() that passes the base limits. keep: a condition on the doc_id of the labelled rows, to hold others out.
    Of rows of one id the one of the smallest hash counts.

    The limit is the score that at most the share `lose` of the good rows exceed; if nearly all bad rows that pass the base limits
    score higher than that, it moves half way up to them, so that fewer good rows are lost."""
    own = rows.join(labelled(labels, keep).withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct("key", "n_words", "n_repeat_words", "f")).alias("r"))
    own = stored(own.where(~base_failed(F.col("r.n_words"), F.col("r.n_repeat_words"))).select("doc_id", F.col("quality").cast("int").alias("quality"), "r.f"), "labelled")
    n = {r["quality"]: r["n"] for r in own.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if n.get(1, 0) < 8:
        discard(own)
        return None, 1.0
    depth = Forest.levels(min(sample, n[1]))
    trees = dealt(own.where("quality = 1"), n[1], sample, seed).groupBy("tree").applyInArrow(_grower(depth, seed), "tree int, n long, axis binary, cut binary, path binary").collect()  # TREES rows
    forest = Forest.of([(r["n"], np.frombuffer(r["axis"], np.int16), np.frombuffer(r["cut"]), np.frombuffer(r["path"])) for r in sorted(trees, key=lambda r: r["tree"])], depth)

    def scored(it):
        for b in it:
            yield pa.RecordBatch.from_pydict({"quality": b.column(0), "anomaly": pa.array(forest.score(_features(b.column(1))), pa.float64())})

    scores = stored(own.select("quality", "f").mapInArrow(scored, "quality int, anomaly double"), "scores")
    limit = _quantile(scores.where("quality = 1"), n[1], 1 - lose)
    if n.get(0, 0):
        low = _quantile(scores.where("quality = 0"), n[0], 0.02)
        limit = max(limit, (limit + low) / 2) if low > limit else limit
    discard(own, scores)
    return forest, limit


def quality_rules(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, the base statistics, base_failed, anomaly (the forest's score), kept. Texts are measured once, for the fit and the verdicts."""
    rows = measured(docs)
    forest, limit = fit(rows, labels, **how)

    def judged(it):
        for b in it:
            score = forest.score(_features(b.column("f"))) if forest is not None and b.num_rows else np.zeros(b.num_rows)
            n, rep = b.column("n_words").to_numpy(), b.column("n_repeat_words").to_numpy()
            failed = base_failed(n, rep)
            cols = {k: b.column(k) for k in b.schema.names if k != "f"}
            yield pa.RecordBatch.from_pydict(cols | {"base_failed": pa.array(failed), "anomaly": pa.array(score), "kept": pa.array(~failed & (score <= limit))})

    schema = SCHEMA.removesuffix(", f array<double>") + ", base_failed boolean, anomaly double, kept boolean"
    return rows.drop("key").mapInArrow(judged, schema)


def passing(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of docs that quality_rules keeps, with all their columns; no text is shuffled; texts are measured again for the verdicts."""
    rows = measured(docs)
    forest, limit = fit(rows, labels, **how)
    discard(rows)
    at = docs.columns.index("text")

    def kept(it):
        for b in it:
            rows = [measure(x.as_py() or "") for x in b.column(at)]
            n, rep = (np.array([r[0][k] for r in rows], np.int64) for k in (0, 4))
            ok = ~base_failed(n, rep)
            if forest is not None and len(rows):
                ok &= forest.score(np.array([r[1] for r in rows])) <= limit
            yield b.filter(pa.array(ok))

    return docs.mapInArrow(kept, docs.schema)
