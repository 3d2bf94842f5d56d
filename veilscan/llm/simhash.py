"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints are reduced to distinct ones and routed by shared bits, so that linked ones meet in a bucket; every bucket is indexed
by sorting its fingerprints by Gray rank and grouping neighbours: a node keeps the bits on which all below it agree. Pairs of nodes
are followed from the roots down, and a pair is dropped as soon as the differences of their agreed bits exceed the limit, or when
all below both are linked already. What leaves a bucket is a spanning forest of real links, never all pairs of a group.

Routing: for a limit of d bits, `blocks` blocks of which blocks - d must be equal (every linked pair shares such a set: exact).

Near copies (`without_copies`): the same fingerprints, of the distinct shingles, and the same index give the first links, which are verified on the sets. What is alike
beyond that limit meets by the prefixes of the sets, unless it is linked by then. Each set has a fingerprint of parities too, of which two differ in no more bits than
the sets in shingles: it drops only pairs that cannot be alike. The others are verified, by cells of pairs, so that a set is sent to a cell once and not with every pair.

Defined results: null text is empty; a text without words has fingerprint zero and is linked like any other; a text of fewer words
than a shingle is one shingle; equal rows share a component; a null doc_id never names a component unless it stands alone, where
the component is null; extra columns are not read; an empty table gives no rows."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batches, bytes_of, components, discard, label_by_min, stored, trim

ONE = np.uint64(1)
#: Ids of fingerprints that only rows without doc_id have.
NAMELESS = 1 << 62
FAN = 8


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of k words, repeats included."""
    if not words:
        return np.zeros(0, np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([h(joined, 42)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size) - 1
    start = end - size + 1
    return np.array([h(joined[a:b], 42) for a, b in zip(start[: len(words) - k + 1].tolist(), end[k - 1 :].tolist(), strict=True)], np.uint64)


def _remixed(h: np.ndarray, c: int) -> np.ndarray:
    h = (h ^ np.uint64(c)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def lead(h: np.ndarray, long: int) -> np.ndarray:
    """For each of 64 * long bits, how many hashes have it set, twice, less how many there are. The first 64 bits are h's own, the others of h mixed again."""
    out = np.empty((long, 64), np.int64)
    for w in range(long):
        x = h if w == 0 else _remixed(h, w)
        total = np.zeros(64, np.int64)
        for at in range(0, len(x), 16384):  # very long texts in parts
            total += np.unpackbits(x[at : at + 16384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[w] = 2 * total - len(x)
    return out.reshape(-1)


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of 64 * long bits as rows of uint64."""
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, shingle: int, long: int) -> DataFrame:
    """doc_id, key (a hash of the text), f0.. (as signed longs)."""
    names = [f"f{w}" for w in range(long)]

    def rows(b: pa.RecordBatch) -> dict:
        scores = [lead(shingle_hashes(x.lower().split(), shingle), long) for x in bytes_of(b)]
        s = np.array(scores).reshape(-1, 64 * long)
        f = packed(s > 0).view(np.int64).reshape(-1, long)
        return {"doc_id": b.column(0), "key": b.column(2)} | {n: f[:, w] for w, n in enumerate(names)}

    fields = [("doc_id", pa.int64()), ("key", pa.int64()), *((n, pa.int64()) for n in names)]
    text = "doc_id long, key long, " + ", ".join(f"{n} long" for n in names)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key")).mapInArrow(batches(rows, pa.schema(fields)), text)


# ---------------------------------------------------------------- the index of the buckets


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of a word in the Gray code."""
    for k in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(k))
    return x


class Index:
    """Levels of nodes over fingerprints sorted by bucket and Gray rank; FAN neighbours of a bucket make a node of the next level."""

    def __init__(self, bucket: np.ndarray, f: np.ndarray):
        level = {"value": f, "mask": np.full_like(f, ~np.uint64(0)), "first": np.arange(len(f)), "count": np.zeros(len(f), np.int64), "bucket": bucket}
        self.levels = [level]
        while True:
            b = level["bucket"]
            new = np.r_[True, b[1:] != b[:-1]]
            run = np.maximum.accumulate(np.where(new, np.arange(len(b)), 0))
            if new.all():
                break
            head = np.nonzero((np.arange(len(b)) - run) % FAN == 0)[0]
            value, mask = level["value"], level["mask"]
            both, any_ = np.bitwise_and.reduceat(value, head, axis=0), np.bitwise_or.reduceat(value | ~mask, head, axis=0)
            agreed = np.bitwise_and.reduceat(mask, head, axis=0) & ~(both ^ any_)
            level = {"value": both & agreed, "mask": agreed, "first": head, "count": np.diff(np.r_[head, len(b)]), "bucket": b[head]}
            self.levels.append(level)

    def forest(self, item: np.ndarray, n: int, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Links (a, b, bits) between items of the same bucket within the limit: a spanning forest of each component. item: the number (below n) of each row."""
        label, found = np.arange(n), []
        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top]["first"]))
        todo = [(top, roots, roots)] if top else []
        spread = self._spread(label[item])
        while todo:
            at, u, v = todo.pop()
            if len(u) > 16384:
                todo += [(at, u[k : k + 16384], v[k : k + 16384]) for k in range(0, len(u), 16384)]
                continue
            low, high = spread[at]
            open_ = ~((low[u] == high[u]) & (low[v] == high[v]) & (low[u] == low[v]))
            u, v = u[open_], v[open_]
            up, down = self.levels[at], self.levels[at - 1]
            step = np.arange(FAN)
            i = up["first"][u][:, None, None] + step[None, :, None]
            j = up["first"][v][:, None, None] + step[None, None, :]
            ok = (step[None, :, None] < up["count"][u][:, None, None]) & (step[None, None, :] < up["count"][v][:, None, None])
            ok &= (i <= j) if at > 1 else (i < j)
            i, j = np.broadcast_to(i, ok.shape)[ok], np.broadcast_to(j, ok.shape)[ok]
            bits = np.zeros(len(i), np.int64)
            for w in range(down["value"].shape[1]):
                bits += np.bitwise_count((down["value"][i, w] ^ down["value"][j, w]) & down["mask"][i, w] & down["mask"][j, w])
            near = bits <= limit
            i, j, bits = i[near], j[near], bits[near]
            if not len(i):
                continue
            if at > 1:
                todo.append((at - 1, i, j))
                continue
            a, b = item[i], item[j]
            new = self._join(label, a, b, bits)
            if len(new[0]):
                found.append(new)
                label = label_by_min(n, new[0], new[1], label)
                spread = self._spread(label[item])
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def pairs(self, label: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of rows of one bucket within the limit whose labels differ, some thousands at a time."""
        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top]["first"]))
        todo, spread, step = [(top, roots, roots)] if top else [], self._spread(label), np.arange(FAN)
        while todo:
            at, u, v = todo.pop()
            if len(u) > 4096:
                todo += [(at, u[k : k + 4096], v[k : k + 4096]) for k in range(0, len(u), 4096)]
                continue
            low, high = spread[at]
            open_ = ~((low[u] == high[u]) & (low[v] == high[v]) & (low[u] == low[v]))
            u, v = u[open_], v[open_]
            up, down = self.levels[at], self.levels[at - 1]
            i = up["first"][u][:, None, None] + step[None, :, None]
            j = up["first"][v][:, None, None] + step[None, None, :]
            ok = (step[None, :, None] < up["count"][u][:, None, None]) & (step[None, None, :] < up["count"][v][:, None, None])
            ok &= (i <= j) if at > 1 else (i < j)
            i, j = np.broadcast_to(i, ok.shape)[ok], np.broadcast_to(j, ok.shape)[ok]
            bits = np.zeros(len(i), np.int64)
            for w in range(down["value"].shape[1]):
                bits += np.bitwise_count((down["value"][i, w] ^ down["value"][j, w]) & down["mask"][i, w] & down["mask"][j, w])
            near = bits <= limit
            i, j = i[near], j[near]
            if at > 1:
                todo += [(at - 1, i, j)] if len(i) else []
            elif (new := label[i] != label[j]).any():
                yield i[new], j[new]

    def _spread(self, own: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Smallest and largest label below each node of each level."""
        out = [(own, own)]
        for level in self.levels[1:]:
            out.append((np.minimum.reduceat(out[-1][0], level["first"]), np.maximum.reduceat(out[-1][1], level["first"])))
        return out

    @staticmethod
    def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray, bits: np.ndarray) -> tuple:
        """Of the links, those that a minimum spanning forest of the components needs: each component takes its shortest link, again and again."""
        label, took = label.copy(), []
        live = label[a] != label[b]
        a, b, bits = a[live], b[live], bits[live]
        order = np.argsort(bits, kind="stable")
        a, b, bits = a[order], b[order], bits[order]
        while len(a):
            best = np.full(len(label), len(a))
            rank = np.arange(len(a))
            np.minimum.at(best, label[a], rank)
            np.minimum.at(best, label[b], rank)
            pick = np.unique(best[best < len(a)])
            took.append((a[pick], b[pick], bits[pick]))
            label = label_by_min(len(label), a[pick], b[pick], label)
            live = label[a] != label[b]
            a, b, bits = a[live], b[live], bits[live]
        return tuple(np.concatenate(x) for x in zip(*took, strict=True)) if took else (np.zeros(0, np.int64),) * 3


def _linked(long: int, limit: int):
    """mapInArrow function over whole buckets (bucket, node, f0..): links (a, b, bits), a > b."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in it if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        bucket, node = t.column("bucket").to_numpy(), t.column("node").to_numpy()
        f = np.stack([t.column(f"f{w}").to_numpy().view(np.uint64) for w in range(long)], axis=1)
        order = np.lexsort([gray_rank(f[:, w]) for w in reversed(range(long))] + [bucket])
        bucket, node, f = bucket[order], node[order], f[order]
        lone = np.r_[True, bucket[1:] != bucket[:-1]] & np.r_[bucket[1:] != bucket[:-1], True]
        bucket, node, f = bucket[~lone], node[~lone], f[~lone]
        if not len(node):
            return
        names, item = np.unique(node, return_inverse=True)
        index = Index(bucket, f)
        a, b, bits = index.forest(item, len(names), limit)
        x, y = names[a], names[b]
        yield pa.RecordBatch.from_pydict({"a": np.maximum(x, y), "b": np.minimum(x, y), "bits": bits.astype(np.int32)})
        del index, t, bucket, node, f, names, item
        trim()

    return run


def _block_sets(limit: int, n: int) -> list[int]:
    """Masks of which every pair within the limit agrees on one: blocks - limit of the blocks. The number of blocks suits n fingerprints: buckets stay
    small while no more copies are dealt than that takes. Exact for any number."""
    def cost(blocks: int) -> float:
        return math.comb(blocks, limit) * (1 + n * 2.0 ** (-64 * (blocks - limit) / blocks) * 0.005)

    blocks = min(range(limit + 1, limit + 5), key=cost)
    edges = [64 * k // blocks for k in range(blocks + 1)]
    parts = [((1 << edges[k + 1]) - (1 << edges[k])) for k in range(blocks)]
    return [sum(c) for c in itertools.combinations(parts, blocks - limit)]


def _route_blocks(sets: list[int]):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            f = b.column("f0").to_numpy().view(np.uint64)
            keys = np.stack([_remixed(f & np.uint64(m), k + 7) for k, m in enumerate(sets)], axis=1)
            yield _dealt(b, keys, 1)

    return run


def _dealt(b: pa.RecordBatch, keys: np.ndarray, long: int) -> pa.RecordBatch:
    at = np.repeat(np.arange(b.num_rows), keys.shape[1])
    cols = {n: b.column(b.schema.get_field_index(n)).to_numpy()[at] for n in ("node", *(f"f{w}" for w in range(long)))}
    return pa.RecordBatch.from_pydict({"bucket": keys.reshape(-1).view(np.int64)} | cols)


def distinct_nodes(prints: DataFrame, long: int) -> DataFrame:
    """Each distinct fingerprint once: node (the smallest doc_id), f0.. . Counts combine before they shuffle."""
    f = [f"f{w}" for w in range(long)]
    nameless = F.lit(NAMELESS) + F.shiftrightunsigned(F.xxhash64(*f), 3)
    return prints.groupBy(*f).agg(F.min("doc_id").alias("node")).withColumn("node", F.coalesce("node", nameless))


def links(nodes: DataFrame, limit: int) -> DataFrame:
    """(a, b, bits): a spanning forest of the links within the limit. nodes: stored distinct_nodes()."""
    n = nodes.count()
    sets = _block_sets(limit, n)
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * len(sets) // 1_000_000 + 1)
    dealt = nodes.select("node", "f0").mapInArrow(_route_blocks(sets), "bucket long, node long, f0 long").repartition(parts, "bucket")
    return dealt.mapInArrow(_linked(1, limit), "a long, b long, bits int").groupBy("a", "b").agg(F.min("bits").alias("bits"))


def simhash_components(docs: DataFrame, shingle: int = 4, limit: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id: fingerprints of 64 bits that differ in at most `limit` bits are linked."""
    prints = stored(fingerprints(docs, shingle, 1), "prints")
    nodes = stored(distinct_nodes(prints, 1), "nodes")
    roots = components(links(nodes, limit))
    named = nodes.join(roots, "node", "left").select("f0", F.coalesce("root", "node").alias("root"))
    named = named.select("f0", F.when(F.col("root") < NAMELESS, F.col("root")).alias("component_id"))
    out = prints.join(named, "f0")  # the hot fingerprints are on the left, one row for each on the right: a skewed join is split
    return out.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- near copies

#: Of so many documents one tells which shingles are common, those that at least COMMON of these have, at most MOST_COMMON. This only settles the order in which
#: prefixes take shingles: any order is exact, common ones last keeps the lists short. STARS: rounds in which every node asks for the likeliest of TRIED partners in one list;
#: they only join large groups early, before all pairs that are left are asked.
ONE_OF, COMMON, MOST_COMMON, STARS, TRIED = 8, 3, 300_000, 3, 64
#: Words of a fingerprint of parities, words of what the index sorts, and the size of lists from which on it is built.
PARITY, FOLDED, LARGE = 32, 4, 48
#: Bits of 64 in which linked fingerprints differ at most, and about the bytes that a cell of pairs gets of a group.
BITS, CELL = 6, 16_000_000


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """The distinct shingles of a text as ascending 64-bit hashes."""
    return np.unique(shingle_hashes(text.lower().split(), k))


def _node(s: np.ndarray) -> int:
    """The name of a set, as a signed long: texts of equal sets share it."""
    return xxhash.xxh64_intdigest(s.tobytes(), 7) - (1 << 63)


def parities(s: np.ndarray, words: int = 0) -> np.ndarray:
    """Bit k: whether the hashes of a set that fall on k are odd in number. A shingle that one of two sets has turns one bit, so fingerprints differ in no more bits than the sets.
    Fingerprints of more words (a power of two times PARITY) fold to those of fewer."""
    size = 64 * (words or PARITY)
    return np.packbits((np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8), bitorder="little")


def wide(n: int) -> int:
    """Words of parities that tell sets of n shingles apart: a bit a shingle, PARITY at least."""
    return PARITY << (max(n - 1, 0) // (64 * PARITY)).bit_length()


def _apart(n: np.ndarray, least: float) -> np.ndarray:
    """In how many shingles two sets of n shingles altogether differ at most, at a Jaccard similarity of `least` or more."""
    return np.floor(n * (1 - least) / (1 + least) + 1e-9).astype(np.int64)


def prefix_size(n: int, least: float) -> int:
    """Of two sets with a Jaccard similarity of `least`, both have so many first shingles (in one order for all) that one of these is common to both."""
    return n - math.ceil(least * n - 1e-9) + 1 if n else 0


def _common(shingle: int):
    """The distinct shingles of each text, a row for each."""
    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for x in bytes_of(b):
                yield pa.RecordBatch.from_pydict({"shingle": shingle_set(x, shingle).view(np.int64)})
        trim()

    return rows


def _prefixes(shingle: int, least: float, common: np.ndarray, rank: np.ndarray):
    """doc_id, key, node, n (shingles), f0 (fingerprint), prefix (those that lists are made of) and bits (parities). common: ascending; rank: their places in the order, after
    all others."""
    def rows(b: pa.RecordBatch) -> dict:
        out = {"doc_id": b.column(0), "key": b.column(2), "node": [], "n": [], "f0": [], "prefix": [], "bits": []}
        for x in bytes_of(b):
            s = shingle_set(x, shingle)
            p = prefix_size(len(s), least)
            at = np.minimum(np.searchsorted(common, s), max(len(common) - 1, 0))
            late = common[at] == s if len(common) else np.zeros(len(s), bool)
            first = s[~late][:p]
            if len(first) < p:
                first = np.r_[first, s[late][np.argsort(rank[at[late]], kind="stable")][: p - len(first)]]
            out["node"].append(_node(s))
            out["n"].append(len(s))
            out["f0"].append(int(packed(lead(s, 1)[None] > 0).view(np.int64)[0, 0]))
            out["prefix"].append(first.tobytes())
            out["bits"].append(parities(s).tobytes())
        return out

    return batches(rows, pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("f0", pa.int64()), ("prefix", pa.binary()), ("bits", pa.binary())]))


def _sets(shingle: int):
    """node, n, the set and as many parities as suit it."""
    def rows(b: pa.RecordBatch) -> dict:
        got = [shingle_set(x, shingle) for x in bytes_of(b)]
        return {"node": [_node(s) for s in got], "n": [len(s) for s in got], "set": [s.tobytes() for s in got], "wide": [parities(s, wide(len(s))).tobytes() for s in got]}

    return batches(rows, pa.schema([("node", pa.int64()), ("n", pa.int32()), ("set", pa.binary()), ("wide", pa.binary())]))


def _postings(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of a prefix."""
    for b in it:
        got = [np.frombuffer(x.as_py(), np.int64) for x in b.column(2)]
        size = np.array([len(x) for x in got], np.int64)
        yield pa.RecordBatch.from_pydict({"shingle": np.concatenate(got) if got else np.zeros(0, np.int64), "node": np.repeat(b.column(0).to_numpy(), size), "n": np.repeat(b.column(1).to_numpy(), size)})


def _lists(least: float):
    """mapInArrow function over whole shingles: the lists of nodes that share one, parted where sizes alone keep the similarity below the limit. Equal lists are one."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in it if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        shingle, node, n = (t.column(c).to_numpy() for c in ("shingle", "node", "n"))
        order = np.lexsort([node, n, shingle])
        shingle, node, n = shingle[order], node[order], n[order]
        head = np.nonzero(np.r_[True, (shingle[1:] != shingle[:-1]) | (n[:-1] < least * n[1:] - 1e-9)])[0]
        size = np.diff(np.r_[head, len(node)])
        name = np.add.reduceat(_remixed(node.view(np.uint64), 11), head) ^ _remixed(size.astype(np.uint64), 13)
        keep = np.zeros(len(head), bool)
        keep[np.unique(name, return_index=True)[1]] = True
        rows = np.repeat(keep & (size > 1), size)
        yield pa.RecordBatch.from_pydict({"list": np.repeat(name, size)[rows].view(np.int64), "node": node[rows], "n": n[rows]})
        del t, shingle, node, n, order
        trim()

    return run


def _candidates(head: np.ndarray, size: np.ndarray, n: np.ndarray, bits: np.ndarray, label: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one list whose labels differ, unless their sizes or fingerprints tell that they are not alike. head, size: of lists; rows ascend by n in each."""
    near = lambda c, d: np.minimum(n[c], n[d]) >= least * np.maximum(n[c], n[d]) - 1e-9

    def fine(c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = near(c, d) & (label[c] != label[d])
        c, d = c[ok], d[ok]
        ok = np.bitwise_count(bits[c] ^ bits[d]).sum(1, dtype=np.int64) <= _apart(n[c] + n[d], least)
        return c[ok], d[ok]

    few = size <= LARGE
    end = np.repeat(head + size, size)
    at = np.nonzero(np.repeat(few, size))[0]
    for k in range(1, LARGE):
        at = at[at + k < end[at]]
        at = at[near(at, at + k)]  # sizes ascend: what is too far is too far from all that follow
        for a in range(0, len(at), 65536):
            yield fine(at[a : a + 65536], at[a : a + 65536] + k)
    for a, m in zip(head[~few].tolist(), size[~few].tolist(), strict=True):
        own = np.bitwise_xor.reduce(bits[a : a + m].reshape(m, PARITY // FOLDED, FOLDED), axis=1)
        order = np.lexsort([gray_rank(own[:, w]) for w in reversed(range(FOLDED))])
        for i, j in Index(np.zeros(m, np.int64), own[order]).pairs(label[a + order], int(_apart(2 * n[a : a + m].max(), least))):
            yield fine(a + order[i], a + order[j])


_LIST = pa.schema([("list", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("bits", pa.binary())])


def _read_lists(it: Iterator[pa.RecordBatch], sort) -> tuple | None:
    """Columns list, node, n, bits (rows of words) and the others of whole lists, sorted; each row once, and the heads and sizes of lists."""
    got = [b for b in it if b.num_rows]
    if not got:
        return None
    t = pa.Table.from_batches(got)
    cols = {c: t.column(c).to_numpy() for c in t.schema.names if c != "bits"}
    bits = np.frombuffer(b"".join(x.as_py() for x in t.column("bits")), np.uint64).reshape(-1, PARITY)
    order = np.lexsort(sort(cols))
    part, node = cols["list"][order], cols["node"][order]
    order = order[np.r_[True, (part[1:] != part[:-1]) | (node[1:] != node[:-1])]]  # several partitions may have had the list
    cols = {c: x[order] for c, x in cols.items()}
    head = np.nonzero(np.r_[True, cols["list"][1:] != cols["list"][:-1]])[0]
    return cols, bits[order], head, np.diff(np.r_[head, len(order)])


def _alive(least: float):
    """mapInArrow function over whole lists (list, node, n, bits): the rows that have a partner."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (got := _read_lists(it, lambda x: [x["node"], x["n"], x["list"]])) is None:
            return
        x, bits, head, size = got
        keep = np.zeros(len(bits), bool)
        for c, d in _candidates(head, size, x["n"].astype(np.int64), bits, np.arange(len(bits)), least):
            keep[c] = keep[d] = True
        at = np.nonzero(keep)[0]
        for k in range(0, len(at), 16384):
            own = at[k : k + 16384]
            yield pa.RecordBatch.from_arrays([pa.array(x[c][own]) for c in ("list", "node", "n")] + [pa.array([r.tobytes() for r in bits[own]], pa.binary())], schema=_LIST)
        trim()

    return run


def _asked(least: float, star: int):
    """mapInArrow function over whole lists (list, node, n, bits, root, own): pairs (a, b), a > b, of different roots, and n of the smaller. star: the number of a round in which each row of
    its own asks for one partner, 0: all pairs."""

    def told(c: np.ndarray, d: np.ndarray, node: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.unique(np.stack([np.maximum(node[c], node[d]), np.minimum(node[c], node[d]), np.minimum(n[c], n[d])], 1), axis=0)

    def nearest(x: dict, bits: np.ndarray, head: np.ndarray, size: np.ndarray, n: np.ndarray) -> np.ndarray:
        """For each row that asks in its list the one of the fewest differing bits among TRIED rows of other roots that may be alike."""
        begin, room = np.repeat(head, size), np.repeat(size, size)
        out = [np.zeros((0, 3), np.int64)]
        at = np.nonzero(x["own"] & (room > 1))[0]
        for k in range(0, len(at), 512):
            d = at[k : k + 512]
            jump = _remixed(x["node"][d].view(np.uint64), 300 + star)[:, None] + np.arange(TRIED, dtype=np.uint64)[None, :] * _remixed(room[d].astype(np.uint64), 301)[:, None]
            # few rows: all of them in turn; many: pseudo-random ones
            step = np.where(room[d][:, None] <= TRIED, np.arange(TRIED)[None, :], (jump % room[d][:, None].astype(np.uint64)).astype(np.int64))
            c = begin[d][:, None] + step % room[d][:, None]
            apart = np.bitwise_count(bits[c] ^ bits[d][:, None, :]).sum(2, dtype=np.int64)
            small, large = np.minimum(n[c], n[d][:, None]), np.maximum(n[c], n[d][:, None])
            ok = (x["root"][c] != x["root"][d][:, None]) & (small >= least * large - 1e-9) & (apart <= _apart(small + large, least))
            apart = np.where(ok, apart, 1 << 30)
            best = np.argmin(apart, 1)
            has = ok[np.arange(len(d)), best]
            out.append(told(c[np.arange(len(d)), best][has], d[has], x["node"], n))
        return np.unique(np.concatenate(out), axis=0)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (got := _read_lists(it, lambda x: [x["node"], x["n"], x["list"]])) is None:
            return
        x, bits, head, size = got
        n, node, root = x["n"].astype(np.int64), x["node"], x["root"]
        found = np.zeros((0, 3), np.int64)
        if star:
            found = nearest(x, bits, head, size, n)
        else:
            parts = []
            for c, d in _candidates(head, size, n, bits, root, least):
                parts.append(told(c, d, node, n))
                if sum(map(len, parts)) > 1_000_000:
                    parts = [np.unique(np.concatenate(parts), axis=0)]
            if parts:
                found = np.unique(np.concatenate(parts), axis=0)
        yield pa.RecordBatch.from_pydict({"a": found[:, 0], "b": found[:, 1], "n": found[:, 2].astype(np.int32)})
        trim()

    return run


def _alike(p: np.ndarray, q: np.ndarray, least: float) -> bool:
    """Whether sets have the similarity."""
    both = len(np.intersect1d(p, q, assume_unique=True))
    return both >= least * (len(p) + len(q) - both) - 1e-9


def _perhaps(p: np.ndarray, q: np.ndarray, n: int, m: int, least: float) -> bool:
    """Whether sets of n and m shingles may have the similarity, by their parities."""
    if min(n, m) < least * max(n, m) - 1e-9:
        return False
    few = min(len(p), len(q))
    p, q = (np.bitwise_xor.reduce(x.reshape(-1, few), axis=0) for x in (p, q))
    return bool(np.bitwise_count(p ^ q).sum(dtype=np.int64) <= _apart(n + m, least))


def _of_cell(least: float, exact: bool):
    """Of the pairs (a, b) of a cell those that are alike, or may be, by what is held of its nodes (node, n, data: the set or parities); with n of the smaller."""

    def run(ask: pa.Table, held: pa.Table) -> pa.Table:
        a, b = ask.column("a").to_numpy(), ask.column("b").to_numpy()
        node, n = held.column("node").to_numpy(), held.column("n").to_numpy().astype(np.int64)
        data, order = [np.frombuffer(x.as_py(), np.uint64) for x in held.column("data")], np.argsort(node)
        i, j = (order[np.searchsorted(node, x, sorter=order)] if len(x) else np.zeros(0, np.int64) for x in (a, b))
        ok = [_alike(data[x], data[y], least) if exact else _perhaps(data[x], data[y], n[x], n[y], least) for x, y in zip(i.tolist(), j.tolist(), strict=True)]
        ok = np.array(ok, bool)
        out = pa.table({"a": a[ok], "b": b[ok], "n": np.minimum(n[i], n[j])[ok].astype(np.int32)})
        del data
        trim()
        return out

    return run


def judged(ask: DataFrame, held: DataFrame, least: float, total: int, exact: bool = True) -> DataFrame:
    """(a, b, n): those of the stored distinct pairs `ask` that _of_cell() accepts. held: node, n, data, `total` bytes of data or so.

    Nodes are dealt into groups and pairs into cells of two groups; each cell gets what is held of a node once, however many of its pairs the node is in."""
    conf = int(ask.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(2 * math.isqrt(conf), math.ceil(total / CELL))
    group = lambda c: F.pmod(F.xxhash64(c), F.lit(groups))
    dealt = ask.select("a", "b", (F.least(group("a"), group("b")) * groups + F.greatest(group("a"), group("b"))).alias("cell"))
    need = dealt.select(F.col("cell").alias("at"), F.col("a").alias("node")).union(dealt.select("cell", "b")).distinct()
    need = need.join(held.select("node", "n", "data").hint("merge"), "node")
    return dealt.groupBy("cell").cogroup(need.groupBy("at")).applyInArrow(_of_cell(least, exact), "a long, b long, n int")


def fingerprint_links(nodes: DataFrame, limit: int) -> DataFrame:
    """(a, b), a > b: links of sets whose fingerprints differ in at most `limit` bits, as the index finds them. nodes: node, f0. Of equal fingerprints the smallest node stands for all."""
    points = stored(nodes.groupBy("f0").agg(F.min("node").alias("node")), "points")
    near = links(points, limit).select("a", "b")
    same = nodes.select(F.col("node").alias("a"), "f0").join(points.withColumnRenamed("node", "b").hint("merge"), "f0").where("a <> b").select("a", "b")
    out = stored(near.union(same), "near")
    discard(points)
    return out


def without_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs, with all columns, without near copies: of each group linked by a Jaccard similarity of the distinct shingles the row of the smallest doc_id stays.

    SimHash fingerprints of the distinct shingles that differ in at most BITS bits are linked by the Gray-order index, and what is alike of that joins first. Fingerprints of
    sets that alike can differ in more, so the rest is found exactly: two such sets share a shingle among the first of each (`prefix_size`), so they meet in the list of that
    shingle. In some rounds every text asks for its likeliest partner of a list, which joins large groups; the last asks all pairs of a list that are in different
    components still, may be alike by their parities and have not failed. Every link is verified on the whole sets.

    Rows of equal doc_id and text count as one; rows without doc_id stay only if no named row is in their group."""
    spark = docs.sparkSession
    row = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(NAMELESS)).alias("_id")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key"))
    seen = own.where(F.pmod(F.xxhash64("key"), F.lit(ONE_OF)) == 0).dropDuplicates(["key"]).mapInArrow(_common(shingle), "shingle long")
    top = seen.groupBy("shingle").count().where(F.col("count") >= COMMON).orderBy(F.desc("count"), "shingle").limit(MOST_COMMON).toArrow()
    common, count = top.column("shingle").to_numpy().view(np.uint64), top.column("count").to_numpy()
    order = np.argsort(common)
    rank = np.empty(len(order), np.int64)
    rank[np.lexsort([common, count])] = np.arange(len(order))
    prefixes = _prefixes(shingle, similarity, common[order], rank[order])
    prints = stored(own.mapInArrow(prefixes, "doc_id long, key long, node long, n int, f0 long, prefix binary, bits binary"), "prints")
    nodes = prints.groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", "f0", "prefix", "bits")))
    conf = int(spark.conf.get("spark.sql.shuffle.partitions"))

    near = fingerprint_links(prints.groupBy("node").agg(F.first("f0").alias("f0")), BITS)
    held = prints.groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("data"))
    close = stored(judged(near, held, similarity, 8 * PARITY * near.count(), exact=False), "close")
    discard(near)

    total = prints.agg(F.sum(F.octet_length("prefix") / 8)).first()[0] or 0
    dealt = nodes.select("node", "n", "prefix").mapInArrow(_postings, "shingle long, node long, n int").repartition(max(conf, int(total) // 1_000_000 + 1), "shingle")
    met = stored(dealt.mapInArrow(_lists(similarity), "list long, node long, n int"), "met")
    parts = max(conf, met.count() // 1_000_000 + 1)
    # parities come to the rows of lists; rows without a partner that may be alike go, before any set is made
    met_bits = met.join(nodes.select("node", "bits").hint("merge"), "node").select("list", "node", "n", "bits")
    lists = stored(met_bits.repartition(parts, "list").mapInArrow(_alive(similarity), "list long, node long, n int, bits binary"), "lists")
    discard(met)

    asked = lists.select("node").union(close.select("a")).union(close.select("b")).distinct()
    rows = prints.join(asked.hint("merge"), "node", "left_semi").groupBy("node").agg(F.min(F.struct(row("doc_id"), F.col("key").alias("_key"))).alias("e")).select("e.*").distinct()
    texts = docs.select("text", row("doc_id"), F.xxhash64("text").alias("_key")).join(rows.hint("merge"), ["_id", "_key"], "left_semi").dropDuplicates(["_id", "_key"])
    sets = stored(texts.select("text").mapInArrow(_sets(shingle), "node long, n int, set binary, wide binary"), "sets")
    shingles = sets.agg(F.sum("n")).first()[0] or 0

    good = roots = failed = None
    for star in (None, *range(1, STARS + 1), 0):
        if star is None:  # what the fingerprints have linked
            ask = close
        else:
            now = lists.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
            if star:  # of the lists that a node is in, one asks for it: no more pairs than nodes
                place = F.xxhash64("list", F.lit(star))
                now = now.withColumn("own", place == F.min(place).over(Window.partitionBy("node")))
            else:
                now = now.withColumn("own", F.lit(True))
            ask = now.select("list", "node", "n", "bits", "root", "own").repartition(parts, "list").mapInArrow(_asked(similarity, star), "a long, b long, n int").distinct()
            ask = stored(ask.join(failed.select("a", "b").hint("merge"), ["a", "b"], "left_anti"), "ask")
        # sets of more shingles than the parities so far have bits are told apart by more of these
        large = ask.where(F.col("n") > 64 * PARITY)
        perhaps = stored(judged(large, sets.withColumnRenamed("wide", "data"), similarity, shingles // 4, exact=False).union(ask.where(F.col("n") <= 64 * PARITY)), "perhaps")
        new = stored(judged(perhaps, sets.withColumnRenamed("set", "data"), similarity, 8 * shingles).select("a", "b"), "good")
        discard(perhaps)
        good, failed = (new, ask) if good is None else (good.union(new), failed.union(ask))
        if roots is not None:
            discard(roots)
        roots = components(good)
    discard(lists, sets, good, failed)
    named = prints.join(roots, "node", "left").select("doc_id", "key", F.coalesce("root", "node").alias("root"))
    first = stored(named.groupBy("root").agg(F.min("doc_id").alias("first")), "first")  # apart from the join, so that a large group can be split there
    gone = named.join(first, "root").where(F.coalesce("doc_id", F.lit(NAMELESS)) != F.coalesce("first", F.lit(NAMELESS)))
    gone = gone.select(row("doc_id"), F.col("key").alias("_key")).distinct().hint("merge")
    # both sides dealt by (id, key) once: the texts are shuffled one time for the join and the repeated rows
    kept = docs.select("*", row("doc_id"), F.xxhash64("text").alias("_key")).join(gone, ["_id", "_key"], "left_anti")
    return kept.dropDuplicates(["_id", "_key"]).select(docs.columns)
