"""Language-model scores: word counts of the corpus as a base, and a causal self-attention model on subword ids.

Tokens are words of the lower-cased text, then one end. The model is a mixture of experts. An expert is a part of the corpus (a language, a kind of text): its words,
counted over all training documents, and its spelling, the chain of subwords of words that a chunk has once, for the words it never saw. What of an expert's words is
left to spelling is settled by absolute discounting, so the model is a distribution over all texts. Which expert speaks next is said, word by word, by one layer of
masked self-attention with a feed-forward part, trained in numpy on subword ids. A document is read in overlapping windows of ids: CONTEXT positions are only looked
at, the SCORED ones after them predict once each, all windows of a group of documents together.

Everything is learned from all training documents, in passes over chunks of documents:

1. A chunk is made and stored as the numbers of its distinct words. Segments of SEGMENT words become vectors of hashed words; the chunk parts its segments by k-means, and centres
   of chunks are merged likewise, 64 at a time, to EXPERTS.
2. Each segment goes to its nearest centre. A chunk sends its distinct words and its subword pairs, with their counts by expert, to ranges of their hashes, which add them up
   and answer.
3. The attention model starts from the experts' token counts and is trained on all windows of all training segments, part by part; after each round the parts' weights are averaged.
   Windows are made from the chunks again in every round, some at a time, and never stored.
4. Chunks meet their answers and are scored.

Chunks are stored, so a repeated task finds the same ones; they are cut from the input's partitions, whatever the ids, so null and repeated ids do not gather.

Defined results: null and empty texts are their end alone; repeated rows get equal scores; a null doc_id is a training document; no training documents give N = 0,
a base over the end alone and spelling by a uniform choice; extra columns are not read; an empty table gives no rows. A text is never cut, so one text is one task's work."""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import read_ranks
from .common import remainder, stored, trim

CONTEXT, SCORED = 8, 24
SPAN = CONTEXT + SCORED
EXPERTS, WIDTH = 12, 16
FEATURES, SEGMENT, LOCAL = 256, 512, 24
CHUNK, RANGE, PIECE = 16_000_000, 16_000_000, 1 << 20
#: So many parts are added up in one task.
STEP = 64
ROUNDS, BATCH = 2, 96
#: Ids of segments that become windows at once, and windows from which on a task trains on what it has, before it reads on.
GROUP, ENOUGH = 400_000, 60_000
DISCOUNT, PAIR, START, STOP, ENDS = 0.75, 5.0, 20.0, 2.0, 1e-6


# ---------------------------------------------------------------- texts, words, subwords


def pieces(text: bytes) -> Iterator[bytes]:
    """A long text in slices that end at white space, so that few words are alive at once."""
    at = 0
    while len(text) - at > PIECE:
        end = at + PIECE
        while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


class Places(dict):
    """Numbers of words in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def numbered(texts: Iterator[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of texts, the numbers of all words, and how many each text has."""
    place, at, n = Places(), [np.zeros(0, np.int32)], []
    for text in texts:
        own = [np.fromiter(map(place.__getitem__, w := p.lower().split()), np.int32, len(w)) for p in pieces(text)]
        at += own
        n.append(sum(map(len, own)))
    return list(place), np.concatenate(at), np.array(n, np.int64)


class Texts:
    """The documents of a chunk as numbers of distinct words. Segments: runs of SEGMENT words of a document, one at least."""

    def __init__(self, ids: list, learn: np.ndarray, words: list[bytes], at: np.ndarray, n: np.ndarray):
        self.ids, self.learn, self.words, self.at, self.n = ids, learn, words, at, n
        self.doc = np.repeat(np.arange(len(n)), n)
        parts = np.maximum(1, -(-n // SEGMENT))
        self.first = np.cumsum(parts) - parts
        inside = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        self.segment = self.first[self.doc] + inside // SEGMENT
        self.owner = np.repeat(np.arange(len(n)), parts)
        self.hash = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))

    def features(self) -> np.ndarray:
        """Segments as unit vectors of hashed words."""
        x = np.bincount(self.segment * FEATURES + (self.hash & np.uint64(FEATURES - 1)).astype(np.int64)[self.at], minlength=len(self.owner) * FEATURES)
        x = x.reshape(-1, FEATURES).astype(np.float32)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


class Subwords:
    """Ids of words, a space before each. Many words are encoded in one call and parted at the tokens that begin with the space."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        ranks = read_ranks(path)
        self.coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1
        self.size = self.end + 1
        self.opens = np.zeros(self.size, bool)
        for b, t in ranks.items():
            self.opens[t] = b[:1] == b" "

    def parts(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each word starts. A word that ends in white space of its own kind, which could swallow the next space, is encoded alone."""
        plain = [w.decode("utf-8", "replace") for w in words]
        odd = [k for k, w in enumerate(plain) if w[-1].isspace() or w[0].isspace()]
        if not odd:
            ids = np.array(self.coder.encode_ordinary(" " + " ".join(plain)) if plain else [], np.uint32)
            start = np.nonzero(self.opens[ids])[0]
            if len(start) == len(words):
                return ids, start
        got = [np.array(self.coder.encode_ordinary(" " + w), np.uint32) for w in plain]
        return np.concatenate(got), np.cumsum([0, *map(len, got[:-1])])

    def flat(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As parts(), some thousands of words at a time; ids as signed numbers, and the end of all after the starts."""
        ids, starts, total = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for k in range(0, len(words), 20000):
            i, s = self.parts(words[k : k + 20000])
            ids.append(i.astype(np.int64))
            starts.append(s + total)
            total += len(i)
        return np.concatenate(ids), np.r_[np.concatenate(starts), total]


@functools.cache
def _subwords(path: str, pattern: str) -> Subwords:
    return Subwords(path, pattern)


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[k], start[k] + 1, ... size[k] of them, for each k."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


# ---------------------------------------------------------------- experts


def centres(x: np.ndarray, mass: np.ndarray, k: int, tries: int = 1, rounds: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """At most k unit centres of unit rows by k-means, the closest of some tries, and the mass of each."""
    own = mass > 0
    x, mass, best = x[own], mass[own].astype(np.float64), (-1.0, np.zeros((0, x.shape[1]), np.float32), np.zeros(0))
    for seed in range(tries if len(x) else 0):
        rng = np.random.default_rng(seed)
        c, far = x[[int(np.argmax(mass))]], np.ones(len(x))
        for _ in range(k - 1):
            far = np.minimum(far, np.maximum(1 - x @ c[-1], 0))
            p = mass * far * far
            if p.sum() <= 1e-9:
                break
            c = np.r_[c, x[[rng.choice(len(x), p=p / p.sum())]]]
        for _ in range(rounds):
            near = np.argmax(x @ c.T, 1)
            total = np.stack([(x[near == j] * mass[near == j][:, None]).sum(0) for j in range(len(c))])
            size = np.linalg.norm(total, axis=1, keepdims=True)
            c = np.where(size > 1e-9, total / np.maximum(size, 1e-9), c).astype(np.float32)
        like = x @ c.T
        close = float((like.max(1) * mass).sum())
        if close > best[0]:
            best = close, c, np.bincount(np.argmax(like, 1), mass, len(c))
    return best[1:]


# ---------------------------------------------------------------- the attention model


@dataclass
class Gate:
    """Which expert speaks next. The weights: embedding, places, key and value, query, output, feed-forward, experts."""

    w: dict[str, np.ndarray]

    MASK = np.triu(np.full((SCORED, SPAN), -1e9, np.float32), CONTEXT + 1)

    @staticmethod
    def start(tokens: np.ndarray, seed: int = 5) -> Gate:
        """Weights that add up what the tokens seen say of the experts. tokens: corpus counts (tokens, experts)."""
        rng, (size, k), d = np.random.default_rng(seed), tokens.shape, WIDTH
        share = (tokens.sum(0) + 1.0) / (tokens.sum() + k)
        says = np.log((tokens + 5 * share) / ((tokens.sum(1, keepdims=True) + 5) * share))
        init = lambda *s: (rng.standard_normal(s) * (0.3 / math.sqrt(s[0]))).astype(np.float32)
        e = (rng.standard_normal((size, d)) * 0.05).astype(np.float32)
        m = min(k, d)
        e[:, :m] = 0.5 * np.clip(says[:, :m], -4, 4)
        kv, o, c = init(d, 2 * d) * 0.3, init(d, d) * 0.3, init(d, k) * 0.3
        kv[np.arange(d), d + np.arange(d)] += 1
        o[np.arange(d), np.arange(d)] += 2
        c[np.arange(m), np.arange(m)] += 3
        return Gate({"e": e, "p": (rng.standard_normal((SPAN, d)) * 0.02).astype(np.float32), "kv": kv, "q": init(d, d), "o": o, "f": init(d, 2 * d), "fb": np.zeros(2 * d, np.float32), "g": init(2 * d, d) * 0.3, "c": c, "cb": np.log(share).astype(np.float32)})

    def forward(self, ids: np.ndarray, keep: bool = False, rows: np.ndarray | None = None):
        """Logits of the experts for the last SCORED positions of windows (n, SPAN), or for some (rows) of these; keep: also what the gradients need."""
        w, n = self.w, len(ids)
        d = w["e"].shape[1]
        x = w["e"][ids]
        x += w["p"]
        kv = x.reshape(-1, d) @ w["kv"]
        k, v = kv[:, :d].reshape(n, SPAN, d), kv[:, d:].reshape(n, SPAN, d)
        own = np.ascontiguousarray(x[:, CONTEXT:]).reshape(-1, d)
        q = (own @ w["q"]).reshape(n, SCORED, d)
        s = q @ k.transpose(0, 2, 1)
        s += self.MASK
        np.minimum(s, 30, out=s)
        np.exp(s, out=s)
        total = (s.reshape(-1, SPAN) @ np.ones(SPAN, s.dtype)).reshape(n, SCORED, 1)
        total += 1e-20
        if keep:
            s /= total
            a = (s @ v).reshape(-1, d)
        else:
            a = s @ v
            a /= total
            a = a.reshape(-1, d)
        if rows is not None:
            own, a = own[rows], a[rows]
        h = own + a @ w["o"]
        m = h @ w["f"]
        m += w["fb"]
        np.maximum(m, 0, out=m)
        z = h + m @ w["g"]
        logits = z @ w["c"]
        logits += w["cb"]
        return (logits, (ids, x, q, k, v, s, a, own, h, m, z)) if keep else logits

    def share(self, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The experts' shares at some positions."""
        x = self.forward(ids, rows=rows)
        np.clip(x, -30, 30, out=x)
        np.exp(x, out=x)
        x /= (x @ np.ones(x.shape[1], x.dtype))[:, None]
        return x

    def gradients(self, ids: np.ndarray, goal: np.ndarray, valid: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of the experts (goal, a number for each position) where valid, and its gradients."""
        w = self.w
        d = w["e"].shape[1]
        logits, (ids, x, q, k, v, s, a, own, h, m, z) = self.forward(ids, True)
        n, rows, use = len(ids), np.arange(len(logits)), valid.reshape(-1).astype(np.float32)
        use /= max(use.sum(), 1)
        logits -= functools.reduce(np.maximum, logits.T)[:, None]  # column by column: rows are short
        p = np.exp(logits, out=logits)
        p /= (p @ np.ones(p.shape[1], p.dtype))[:, None]
        goal = goal.reshape(-1)
        own_p = p[rows, goal]
        loss = -float(np.log(own_p + 1e-20) @ use)
        p[rows, goal] = own_p - 1
        p *= use[:, None]
        one = np.ones(len(p), p.dtype)
        g = {"c": z.T @ p, "cb": one @ p}
        dz = p @ w["c"].T
        g["g"] = m.T @ dz
        dm = dz @ w["g"].T
        dm *= m > 0
        g["f"], g["fb"] = h.T @ dm, one @ dm
        dh = dz + dm @ w["f"].T
        g["o"] = a.T @ dh
        da = dh @ w["o"].T
        mean = np.einsum("ij,ij->i", da, a).reshape(n, SCORED, 1)  # what ds * s adds up to, as a is s @ v
        da = da.reshape(n, SCORED, d)
        ds = da @ v.transpose(0, 2, 1)
        dv = s.transpose(0, 2, 1) @ da
        ds -= mean
        ds *= s
        dq, dk = (ds @ k).reshape(-1, d), ds.transpose(0, 2, 1) @ q
        g["q"] = own.T @ dq
        dkv = np.concatenate([dk.reshape(-1, d), dv.reshape(-1, d)], 1)
        g["kv"] = x.reshape(-1, d).T @ dkv
        dx = (dkv @ w["kv"].T).reshape(n, SPAN, d)
        dx[:, CONTEXT:] += (dh + dq @ w["q"].T).reshape(n, SCORED, d)
        g["p"] = (np.ones(n, dx.dtype) @ dx.reshape(n, -1)).reshape(SPAN, d)
        order = np.argsort(ids.reshape(-1), kind="stable")
        flat = ids.reshape(-1)[order]
        head = np.nonzero(np.r_[True, flat[1:] != flat[:-1]])[0]
        g["e"] = (flat[head], np.add.reduceat(dx.reshape(-1, d)[order], head, axis=0))
        return loss, g

    def fit(self, ids: np.ndarray, goal: np.ndarray, valid: np.ndarray, rate: float, seed: int) -> Gate:
        """One round of Adam over windows: ids (n, SPAN), goal (n), valid (n, SCORED). Only the embeddings of tokens that occur move."""
        seen, inv = np.unique(ids, return_inverse=True)
        ids, names = inv.reshape(ids.shape).astype(np.uint16 if len(seen) <= 1 << 16 else np.int32), [k for k in self.w if k != "e"]
        # all weights but the embeddings lie in one array, so that a step moves them at once
        ends = np.cumsum([0] + [self.w[k].size for k in names])
        rest = np.concatenate([self.w[k].reshape(-1) for k in names])
        w = {k: rest[a:b].reshape(self.w[k].shape) for k, a, b in zip(names, ends, ends[1:], strict=False)} | {"e": self.w["e"][seen]}
        own, (m1, m2, e1, e2) = Gate(w), (np.zeros_like(x) for x in (rest, rest, w["e"], w["e"]))
        order = np.random.default_rng(seed).permutation(len(ids))
        steps = -(-len(ids) // BATCH)
        for step in range(1, steps + 1):
            at = order[(step - 1) * BATCH : step * BATCH]
            _, g = own.gradients(ids[at], np.repeat(goal[at], SCORED), valid[at])
            now = rate * (1 - 0.9 * step / steps)
            rows, x = g.pop("e")
            y = np.concatenate([g[k].reshape(-1) for k in names])
            for grad, a, b in ((y, m1, m2), (x, e1[rows], e2[rows])):
                a *= 0.9
                a += 0.1 * grad
                b *= 0.98
                grad *= grad
                grad *= 0.02
                b += grad
                move = np.sqrt(b * (1 / (1 - 0.98**step)))
                move += 1e-4
                np.divide(a, move, out=move)
                move *= now / (1 - 0.9**step)
                if a is m1:
                    rest -= move
                else:
                    w["e"][rows] -= move
                    e1[rows], e2[rows] = a, b
        out = {k: x for k, x in w.items()}
        out["e"] = self.w["e"].copy()
        out["e"][seen] = w["e"]
        return Gate(out)


def windows(ids: np.ndarray, size: np.ndarray, begins: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of streams of ids, laid end to end, each `size` long: inputs (n, SPAN); whether a position is one of a stream; and whether what follows it is a word or
    the end of the text. begins: which ids start a word. A stream is read as end, its ids; before it stands end again."""
    count = -(-(size + 1) // SCORED)
    start = np.cumsum(count * SCORED) - count * SCORED
    total = int(count.sum()) * SCORED
    given, used, ask = np.full(total, end, np.int64), np.zeros(total, bool), np.zeros(total, bool)
    place = spread(start, size)
    given[place + 1 - (place + 1 == total)] = np.where(place + 1 < total, ids, end)
    given[start] = end
    used[place] = used[start + size] = True
    ask[place[begins]] = ask[start + size] = True
    given = given.reshape(-1, SCORED)
    before = np.full((len(given), CONTEXT), end, np.int64)
    before[1:] = given[:-1, -CONTEXT:]
    before[(start // SCORED)] = end
    return np.concatenate([before, given], 1), used.reshape(-1, SCORED), ask.reshape(-1, SCORED)


# ---------------------------------------------------------------- what chunks and ranges tell each other


def _zip(x: np.ndarray, kind: str) -> bytes:
    """Numbers, byte plane by byte plane."""
    width = np.dtype(kind).itemsize
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype(kind).reshape(-1)).view(np.uint8).reshape(-1, width).T.tobytes())


def _unzip(b: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _names(x: np.ndarray) -> bytes:
    """Ascending numbers as differences."""
    return _zip(np.diff(x.astype(np.uint64), prepend=np.uint64(0)), "<u8")


def _named(b: bytes) -> np.ndarray:
    return np.cumsum(_unzip(b, "<u8"), dtype=np.uint64)


def _counts(x: np.ndarray) -> bytes:
    """Counts by expert (n, experts): expert by expert."""
    return _zip(x.T, "<u4")


def _counted(b: bytes, k: int) -> np.ndarray:
    return _unzip(b, "<u4").reshape(k, -1).T


def _mix(x: np.ndarray) -> np.ndarray:
    """Numbers of pairs as hashes that no two share."""
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def _cuts(h: np.ndarray, ranges: int) -> Iterator[tuple[int, int, int]]:
    """(range, from, to) of ascending hashes."""
    r = ((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    if len(r):
        head = np.nonzero(np.r_[True, r[1:] != r[:-1]])[0]
        yield from zip(r[head].tolist(), head.tolist(), [*head[1:].tolist(), len(r)], strict=True)


_SENT = pa.schema([("chunk", pa.int64()), ("kind", pa.string()), ("r", pa.int32()), ("data", pa.binary()), ("counts", pa.binary())])
SENT = "chunk long, kind string, r int, data binary, counts binary"


CHUNKS = "chunk long, ids array<long>, learn array<boolean>, sizes array<long>, words binary, at binary, centres binary, mass binary"


def _dealt(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, learn, text) of a partition as chunks of about CHUNK bytes, each with the centres of its training segments."""
    part, number, rows, total = TaskContext.get().partitionId() << 24, 0, [], 0

    def chunk() -> pa.RecordBatch:
        words, at, n = numbered(t for _, _, t in rows)
        t = Texts([i for i, _, _ in rows], np.array([x for _, x, _ in rows], bool), words, at, n)
        c, mass = centres(t.features(), np.bincount(t.segment, minlength=len(t.owner)) * t.learn[t.owner], LOCAL)
        cols = {"chunk": pa.array([part + number], pa.int64()), "ids": pa.array([t.ids], pa.list_(pa.int64())), "learn": pa.array([t.learn], pa.list_(pa.bool_())), "sizes": pa.array([n], pa.list_(pa.int64()))}
        blobs = {"words": zstandard.ZstdCompressor(level=1).compress(b" ".join(words)), "at": _zip(at, "<u4"), "centres": c.astype("<f4").tobytes(), "mass": mass.astype("<f8").tobytes()}
        return pa.RecordBatch.from_pydict(cols | {k: pa.array([x], pa.binary()) for k, x in blobs.items()})

    for b in it:
        for i, x, t in zip(b.column(0), b.column(1), b.column(2), strict=True):
            rows.append((i.as_py(), x.as_py(), t.as_py()))
            total += len(rows[-1][2]) + 64
            if total >= CHUNK:
                yield chunk()
                number, rows, total = number + 1, [], 0
    if rows:
        yield chunk()
    trim()


def _texts(x: dict) -> Texts:
    return Texts(x["ids"], np.array(x["learn"], bool), zstandard.ZstdDecompressor().decompress(x["words"]).split(), _unzip(x["at"], "<u4").astype(np.int32), np.array(x["sizes"], np.int64))


def _each(fn):
    """A mapInArrow function: fn(row) -> rows of SENT, for each row."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for k in range(b.num_rows):
                rows = fn(b.slice(k, 1).to_pylist()[0])
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(_SENT), _SENT, strict=True)], schema=_SENT)
        trim()

    return run


def _gathered(rows: list, k: int, tries: int = 1) -> tuple[np.ndarray, np.ndarray]:
    x = np.concatenate([np.zeros((0, FEATURES), np.float32)] + [np.frombuffer(d, "<f4").reshape(-1, FEATURES) for d, _ in rows])
    return centres(x, np.concatenate([np.zeros(0)] + [np.frombuffer(m, "<f8") for _, m in rows]), k, tries)


def _merged(t: pa.Table) -> pa.Table:
    c, mass = _gathered(list(zip(t.column("data").to_pylist(), t.column("counts").to_pylist(), strict=True)), LOCAL)
    return pa.table([[t.column("chunk")[0].as_py()], ["c"], [0], [c.astype("<f4").tobytes()], [mass.astype("<f8").tobytes()]], schema=_SENT)


def find_experts(chunks: DataFrame) -> np.ndarray:
    """Centres of the experts. Centres are merged STEP chunks at a time until few are left."""
    got = chunks.select(F.expr("abs(xxhash64(chunk))").alias("chunk"), F.lit("c").alias("kind"), F.lit(0).alias("r"), F.col("centres").alias("data"), F.col("mass").alias("counts"))
    groups = chunks.count()
    while groups > STEP:
        groups = math.ceil(groups / STEP)
        got = got.withColumn("chunk", F.col("chunk") % groups).groupBy("chunk").applyInArrow(_merged, SENT)
    rows = sorted((bytes(r["data"]), bytes(r["counts"])) for r in got.select("data", "counts").collect())  # STEP at most, LOCAL centres in each
    c = _gathered(rows, EXPERTS, 20)[0]
    return c if len(c) else np.zeros((1, FEATURES), np.float32)


#: Tables by token: words of spelling that start with it, its places inside of them, places before another, places at their end, all its places; after these, the ends of texts.
TABLES = 5


def _counter(path: str, pattern: str, ranges: int, c: np.ndarray):
    def run(x: dict) -> list[tuple]:
        sub, t, k = _subwords(path, pattern), _texts(x), len(c)
        own = np.argmax(t.features() @ c.T, 1)
        words = np.bincount(t.at[use := t.learn[t.doc]].astype(np.int64) * k + own[t.segment[use]], minlength=len(t.words) * k).reshape(-1, k)
        chunk, rows = x["chunk"], []
        order = np.argsort(t.hash, kind="stable")
        h = t.hash[order]
        rows += [(chunk, "w", r, _names(h[a:b]), _counts(words[order[a:b]])) for r, a, b in _cuts(h, ranges)]
        ids, start = sub.flat(t.words)
        size = np.diff(start)
        word = np.repeat(np.arange(len(t.words)), size)
        once = words.sum(1) == 1
        expert = np.argmax(words, 1)
        inner, last = np.ones(len(ids), bool), np.zeros(len(ids), bool)
        inner[start[:-1]], last[start[1:] - 1] = False, True
        at = np.nonzero(inner)[0]
        names, inv = np.unique(ids[at - 1] * sub.size + ids[at], return_inverse=True)
        few = once[word[at]]
        pairs = np.bincount(inv[few] * k + expert[word[at[few]]], minlength=len(names) * k).reshape(-1, k)
        order = np.argsort(h := _mix(names), kind="stable")
        rows += [(chunk, "p", r, _names(h[order[a:b]]), _counts(pairs[order[a:b]])) for r, a, b in _cuts(h[order], ranges)]
        table = np.zeros((TABLES * sub.size + 1, k), np.int64)
        spelt = once[word]
        for n, (token, where) in enumerate(((ids, spelt & ~inner), (ids, spelt & inner), (ids, spelt & ~last), (ids, spelt & last))):
            table[n * sub.size : (n + 1) * sub.size] = np.bincount(token[where] * k + expert[word[where]], minlength=sub.size * k).reshape(-1, k)
        for e in range(k):
            table[4 * sub.size : 5 * sub.size, e] = np.bincount(ids, words[word, e], sub.size)
        final = np.r_[t.first[1:], len(t.owner)] - 1
        table[-1] = np.bincount(own[final[t.learn]], minlength=k)
        some = np.nonzero(table.any(1))[0]
        rows.append((chunk, "t", 0, _names(some), _counts(table[some])))
        return rows

    return run


def _totals(k: int):
    """For each chunk's names of a range their corpus counts by expert; a row of chunk -1 adds up the range: for each expert its words and its distinct words, then all distinct words."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("chunk")
        parts = [_named(x.as_py()) for x in t.column("data")]
        q, inv = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.zeros((len(q), k), np.int64)
        ends = np.cumsum([0, *map(len, parts)])
        for a, b, x in zip(ends, ends[1:], t.column("counts"), strict=False):
            total[inv[a:b]] += _counted(x.as_py(), k)  # names of a chunk are distinct
        counts = [_counts(total[inv[a:b]]) for a, b in zip(ends, ends[1:], strict=False)]
        stats = np.r_[total.sum(0), (total > 0).sum(0), total.any(1).sum()]
        stats = ",".join(map(str, stats.tolist())).encode()
        chunks, n = t.column("chunk").to_pylist(), t.num_rows
        kind, r = t.column("kind")[0].as_py(), t.column("r")[0].as_py()
        return pa.table([[*chunks, -1], [kind] * (n + 1), [r] * (n + 1), [*[None] * n, stats], [*counts, None]], schema=_SENT)

    return run


def _added(k: int):
    """Tables of several chunks in one."""

    def run(t: pa.Table) -> pa.Table:
        q, total = np.zeros(0, np.uint64), np.zeros((0, k), np.int64)
        for data, counts in zip(t.column("data"), t.column("counts"), strict=True):
            own = _named(data.as_py())
            both = np.union1d(q, own)
            new = np.zeros((len(both), k), np.int64)
            new[np.searchsorted(both, q)] += total
            new[np.searchsorted(both, own)] += _unzip(counts.as_py(), "<i8").reshape(k, -1).T if t.column("r")[0].as_py() else _counted(counts.as_py(), k)
            q, total = both, new
        return pa.table([[t.column("chunk")[0].as_py()], ["t"], [1], [_names(q)], [_zip(total.T, "<i8")]], schema=_SENT)

    return run


def _tables(sent: DataFrame, groups: int, size: int, k: int) -> np.ndarray:
    """The tables by token of the whole corpus, as many numbers as the vocabulary has: (TABLES, tokens, experts), and the ends of texts in one row more."""
    got = sent.where("kind = 't'").withColumn("chunk", F.expr("abs(xxhash64(chunk))"))
    while True:
        groups = max(1, math.ceil(groups / STEP))
        got = got.withColumn("chunk", F.col("chunk") % groups).groupBy("chunk").applyInArrow(_added(k), SENT)
        if groups == 1:
            break
    out = np.zeros((TABLES * size + 1, k), np.int64)
    for r in got.collect():
        out[_named(bytes(r["data"])).astype(np.int64)] = _unzip(bytes(r["counts"]), "<i8").reshape(k, -1).T
    return out


# ---------------------------------------------------------------- training of the attention model in parts

_PART = pa.schema([("part", pa.int64()), ("n", pa.float64()), ("token", pa.binary()), ("seen", pa.binary()), ("e", pa.binary()), ("rest", pa.binary())])
PART = "part long, n double, token binary, seen binary, e binary, rest binary"


def _rest(w: dict) -> np.ndarray:
    return np.concatenate([w[k].reshape(-1) for k in sorted(w) if k != "e"]).astype(np.float64)


def _weights(e: np.ndarray, rest: np.ndarray, like: dict) -> dict:
    out, at = {"e": e}, 0
    for k in sorted(like):
        if k != "e":
            out[k] = rest[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
            at += like[k].size
    return out


def _part(part: int, n: float, token: np.ndarray, seen: np.ndarray, e: np.ndarray, rest: np.ndarray) -> tuple:
    return part, n, token.astype("<i8").tobytes(), seen.astype("<f8").tobytes(), e.astype("<f8").tobytes(), rest.astype("<f8").tobytes()


def _training(path: str, pattern: str, c: np.ndarray):
    """All windows of the training segments of chunks, GROUP ids at a time: data (the windows), counts (for each its segment's expert and which positions are used)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for k in range(b.num_rows):
                sub, t = _subwords(path, pattern), _texts(b.slice(k, 1).to_pylist()[0])
                own, (ids, start) = np.argmax(t.features() @ c.T, 1), sub.flat(t.words)
                size, words = np.diff(start), np.bincount(t.segment, minlength=len(t.owner))
                total, first = np.bincount(t.segment, size[t.at], len(t.owner)).astype(np.int64), np.cumsum(words) - words
                segs = np.nonzero(t.learn[t.owner] & (words > 0))[0]
                for group in np.split(segs, np.nonzero(np.diff(np.cumsum(total[segs]) // GROUP))[0] + 1):
                    if len(group):
                        picked = t.at[spread(first[group], words[group])]
                        given, used, _ = windows(ids[spread(start[picked], size[picked])], total[group], np.zeros(int(total[group].sum()), bool), sub.end)
                        label = np.repeat(own[group], -(-(total[group] + 1) // SCORED))
                        yield pa.RecordBatch.from_pydict({"data": pa.array([_zip(given, "<u4")], pa.binary()), "counts": pa.array([_zip(np.concatenate([label[:, None], used], 1), "u1")], pa.binary())})

    return run


def _trained(gate: Gate, round_: int, made=None):
    """The weights after a round over each few windows' rows, ENOUGH windows at a time: sums over the windows, of an embedding over the places of its token. made: makes such
    rows from the rows of a partition."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, new, n, seen, got = TaskContext.get().partitionId(), gate, 0, np.zeros(len(gate.w["e"])), []

        def learn() -> None:
            nonlocal new, n, seen
            ids, side = (np.concatenate(x) for x in zip(*got, strict=True))
            got.clear()
            new = new.fit(ids.astype(np.int64), side[:, 0].astype(np.int64), side[:, 1:].astype(bool), 0.02 / (1 + round_), round_)
            n += len(ids)
            seen += np.bincount(ids.reshape(-1), minlength=len(seen))

        for b in made(it) if made else it:
            for d, c in zip(b.column(0), b.column(1), strict=True):
                got.append((_unzip(d.as_py(), "<u4").reshape(-1, SPAN), _unzip(c.as_py(), "u1").reshape(-1, SCORED + 1)))
                if sum(len(x) for x, _ in got) >= ENOUGH:
                    learn()
        if got:
            learn()
        if n:
            token = np.nonzero(seen)[0]
            row = _part(part, n, token, seen[token], new.w["e"][token] * seen[token][:, None], _rest(new.w) * n)
            yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(row, _PART, strict=True)], schema=_PART)
        trim()

    return run


def _summed(t: pa.Table) -> pa.Table:
    rows = t.to_pylist()
    token = np.unique(np.concatenate([np.frombuffer(r["token"], "<i8") for r in rows]))
    seen, e, rest = np.zeros(len(token)), np.zeros((len(token), WIDTH)), 0
    for r in rows:
        at = np.searchsorted(token, np.frombuffer(r["token"], "<i8"))
        seen[at] += np.frombuffer(r["seen"], "<f8")
        e[at] += np.frombuffer(r["e"], "<f8").reshape(-1, WIDTH)
        rest = rest + np.frombuffer(r["rest"], "<f8")
    return pa.table([pa.array([x], f.type) for x, f in zip(_part(rows[0]["part"], sum(r["n"] for r in rows), token, seen, e, rest), _PART, strict=True)], schema=_PART)


def train_gate(kept: DataFrame, parts: int, tokens: np.ndarray, made=None) -> Gate:
    """The attention model, trained on all windows (data, counts) that `made` makes of the rows kept, or that these are, a part of them in each partition (parts at most), in ROUNDS."""
    gate = Gate.start(tokens)
    for k in range(ROUNDS):
        got, groups = (kept if made else kept.select("data", "counts")).mapInArrow(_trained(gate, k, made), PART), parts
        while groups > 1:
            groups = math.ceil(groups / STEP)
            got = got.withColumn("part", F.col("part") % groups).groupBy("part").applyInArrow(_summed, PART)
        rows = got.collect()  # one row, as large as the vocabulary
        if not rows:
            break
        r = rows[0]
        e, at = gate.w["e"].copy(), np.frombuffer(r["token"], "<i8")
        e[at] = np.frombuffer(r["e"], "<f8").reshape(-1, WIDTH) / np.frombuffer(r["seen"], "<f8")[:, None]
        gate = Gate(_weights(e, np.frombuffer(r["rest"], "<f8") / r["n"], gate.w))
    return gate


# ---------------------------------------------------------------- scoring


@dataclass
class Experts:
    """Counts of the corpus. words, types: words and distinct words of each expert; ends: its texts; tables: as in _tables()."""

    words: np.ndarray
    types: np.ndarray
    ends: np.ndarray
    tables: np.ndarray

    def spelling(self, ids: np.ndarray, start: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """Natural logarithms of words' probabilities as chains of subwords (words, experts). pairs: corpus counts for each id after the one before it; any at a word's start."""
        opens, inside, before, stops = self.tables
        smooth = lambda t, b: (t + b * (t.sum(1, keepdims=True) + 0.02) / (t.sum() + 0.02 * len(t))) / (t.sum(0) + b)
        mean = (stops.sum(1, keepdims=True) + 0.5) / (stops.sum(1, keepdims=True) + before.sum(1, keepdims=True) + 1)
        stop = (stops + STOP * mean) / (stops + before + STOP)
        log_open, inside, go, log_stop = np.log(smooth(opens, START)).astype(np.float32), smooth(inside, START).astype(np.float32), np.log1p(-stop).astype(np.float32), np.log(stop).astype(np.float32)
        prev = np.r_[ids[:1], ids[:-1]]
        out = pairs.astype(np.float32)
        out += PAIR * inside[ids]
        out /= (before + PAIR).astype(np.float32)[prev]
        np.log(out, out=out)
        out += go[prev]
        out[start[:-1]] = log_open[ids[start[:-1]]]
        out[start[1:] - 1] += log_stop[ids[start[1:] - 1]]
        return np.add.reduceat(out, start[:-1], axis=0) if len(start) > 1 else np.zeros((0, pairs.shape[1]), np.float32)

    def left(self) -> np.ndarray:
        """What of each expert is left to words that it has not seen."""
        total = self.words + self.ends
        return np.where(total > 0, DISCOUNT * (self.types + (self.ends > 0)) / np.maximum(total, 1), 1.0)

    def seen(self, counts: np.ndarray) -> np.ndarray:
        return np.maximum(counts - DISCOUNT, 0) / np.maximum(self.words + self.ends, 1)

    def log_words(self, counts: np.ndarray, spelt: np.ndarray) -> np.ndarray:
        """Natural logarithms of words' probabilities (words, experts), the end of a text after all."""
        with np.errstate(divide="ignore"):
            out = np.logaddexp(np.log(self.seen(counts)).astype(np.float32), np.log(self.left() * (1 - ENDS)).astype(np.float32) + spelt)
        return np.r_[out, np.log(self.seen(self.ends) + self.left() * ENDS).astype(np.float32)[None]]


FIELDS = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def mixed(gate: Gate, t: Texts, log_words: np.ndarray, ids: np.ndarray, start: np.ndarray, end: int, rows: int = 128) -> np.ndarray:
    """log10 probability of each document."""
    out, size = np.zeros(len(t.n)), np.diff(start)
    high = log_words.max(1)  # the greatest of a word's probabilities, and the others beside it
    rest = np.maximum(np.exp(log_words - high[:, None]), 1e-30)
    ends = np.cumsum(t.n)
    length = np.bincount(t.doc, size[t.at], len(t.n)).astype(np.int64)
    for group in np.split(np.arange(len(t.n)), np.nonzero(np.diff(np.cumsum(length + 32) // 400_000))[0] + 1):
        if not len(group):
            continue
        a, b = int(ends[group[0]] - t.n[group[0]]), int(ends[group[-1]])
        own = t.at[a:b]
        flat = ids[spread(start[own], size[own])]
        begins = np.zeros(len(flat), bool)
        begins[np.cumsum(size[own]) - size[own]] = True
        given, _, ask = windows(flat, length[group], begins, end)
        token = np.insert(own.astype(np.int64), ends[group] - a, len(log_words) - 1)  # the words of each document, then its end
        owner = np.repeat(group, t.n[group] + 1)
        count = np.r_[0, np.cumsum(ask.sum(1))]
        for k in range(0, len(given), rows):
            at = slice(count[k], count[min(k + rows, len(given))])
            p = gate.share(given[k : k + rows], np.nonzero(ask[k : k + rows].reshape(-1))[0])
            own = token[at]
            out += np.bincount(owner[at], np.log(np.einsum("ij,ij->i", p, rest[own], dtype=np.float32).astype(np.float64)) + high[own], len(out))
    return out / math.log(10)


def _scorer(path: str, pattern: str, gate: Gate, experts: Experts, ranges: int, known: int):
    def run(key, chunk: pa.Table, told: pa.Table) -> pa.Table:
        sub, x = _subwords(path, pattern), chunk.to_pylist()[0]
        t, k = _texts(x), len(experts.words)
        answers = {(a, b): c for a, b, c in zip(told.column("kind").to_pylist(), told.column("r").to_pylist(), told.column("counts"), strict=True)}

        def answered(kind: str, h: np.ndarray) -> np.ndarray:
            order, out = np.argsort(h, kind="stable"), np.zeros((len(h), k), np.uint32)
            for r, a, b in _cuts(h[order], ranges):
                out[order[a:b]] = _counted(answers[kind, r].as_py(), k)
            return out

        counts = answered("w", t.hash)
        total, n_docs = counts.sum(1, dtype=np.int64), int(experts.ends.sum())
        n = int(experts.words.sum()) + n_docs
        scale = n + 0.5 * (known + (n_docs > 0) + 1)
        base = np.bincount(t.doc, np.log10((total + 0.5) / scale)[t.at], len(t.n)) + math.log10((n_docs + 0.5) / scale)
        seen = np.bincount(t.doc, (total > 0)[t.at], len(t.n)).astype(np.int64) + (n_docs > 0)
        ids, start = sub.flat(t.words)
        names = np.r_[ids[:1], ids[:-1]] * sub.size + ids
        inner = np.ones(len(ids), bool)
        inner[start[:-1]] = False
        names, inv = np.unique(names[inner], return_inverse=True)
        pairs = np.zeros((len(ids), k), np.uint32)
        pairs[inner] = answered("p", _mix(names))[inv]
        log_words = experts.log_words(counts, experts.spelling(ids, start, pairs))
        del pairs, counts, inv, names
        score = mixed(gate, t, log_words, ids, start, sub.end)
        cols = [t.ids, ~t.learn, t.n + 1, seen, np.full(len(t.n), n), base, score]
        out = pa.table([pa.array(c, f) for c, (_, f) in zip(cols, FIELDS, strict=True)], schema=pa.schema(FIELDS))
        del t, log_words
        trim()
        return out

    return run


def lm_scores(docs: DataFrame, path: str, pattern: str, mod: int = 5, out: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. path: ranks of a byte-level vocabulary.

    Learned from all documents whose crc32(doc_id as text) mod `mod` is not `out`, and their whole texts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), (remainder(F.col("doc_id"), mod) != out).alias("learn"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    rows = rows.withColumn("learn", F.col("learn") | F.col("id").isNull())
    chunks = stored(rows.mapInArrow(_dealt, CHUNKS), "chunks")
    total, n = chunks.select(F.sum(F.octet_length("at") + F.octet_length("words")), F.count("*")).first()
    # ranges take more as there are more chunks, so that messages do not grow with the square of the input
    ranges = max(1, math.ceil((total or 0) / RANGE / max(1.0, math.sqrt((total or 0) / RANGE / 4096))))
    sub, c = _subwords(path, pattern), find_experts(chunks)
    k = len(c)
    sent = stored(chunks.drop("centres", "mass").mapInArrow(_each(_counter(path, pattern, ranges, c)), SENT), "sent")
    told = stored(sent.where("kind in ('w', 'p')").groupBy("kind", "r").applyInArrow(_totals(k), SENT), "told")
    tables = _tables(sent, n, sub.size, k)
    by_token = tables[:-1].reshape(TABLES, sub.size, k)
    stats = np.zeros(2 * k + 1, np.int64)
    told_stats = told.where("chunk = -1 and kind = 'w'").select(F.posexplode(F.split(F.col("data").cast("string"), ",")))
    for r in told_stats.groupBy("pos").agg(F.sum(F.col("col").cast("long")).alias("n")).collect():
        stats[r["pos"]] = r["n"]
    gate = train_gate(chunks.drop("centres", "mass"), n, by_token[4], _training(path, pattern, c))
    experts = Experts(*stats[:-1].reshape(2, k), tables[-1], by_token[:4])
    told = told.where("chunk >= 0").select("chunk", "kind", "r", "counts")
    return chunks.drop("centres", "mass").groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_scorer(path, pattern, gate, experts, ranges, int(stats[-1])), OUT)
