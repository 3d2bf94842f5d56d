"""Removal of byte strings that occur in an earlier document, by difference covers.

A sorted order of all suffixes is not built: what is asked is which neighbours in it share `least` bytes. So the difference-cover
scheme is followed only as far as names repeat:

1. Sample: positions whose offset modulo PERIOD is in COVER. For any two positions a shift below PERIOD takes both into the sample,
   so two equal strings of `least` bytes have equal sampled strings of least - PERIOD + 1 bytes inside. Each sampled suffix is named
   by its first so many bytes; names are sorted, range by range, and only a name that occurs in two documents is followed up.
2. Recursion where names repeat: every suffix from which a repeated sampled one can be reached - sampled or not - is named by its
   first `least` bytes.
3. Merge: these names are sorted, range by range; neighbours that are equal share a prefix of `least` bytes, and all but those of the
   first document mark their bytes for removal.

Names are 64-bit hashes, so no rank has to be agreed on; ranges travel as sorted differences, a few bytes each, and the answers as
one bit each. Documents are dealt into chunks of about CHUNK bytes, ordered by doc_id, so that of two chunks the lower one holds the
smaller ids; an id of many rows, as the missing one can be, gets several chunks of one rank. The chunks of ids follow from a bounded number of ANCHORS. Texts of which a smaller id has an exact copy need no search: all of their strings are there. A group of copies of any
size is spread over the chunks of its ids, and a range holds an even share of all names.

Defined results: null text is empty; nothing of a text shorter than `least` is removed; rows of one doc_id never remove from each other; a null doc_id
counts as larger than any other; extra columns are not read; an empty table gives no rows."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored, trim

PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)
CHUNK, RANGE, PART = 4_000_000, 10_000_000, 1_000_000
#: Quantiles of the ids that chunks are cut from. Ranges take more from so many on, up to WIDEST times as much.
ANCHORS, MANY, WIDEST = 4096, 4096, 8
LAST = (1 << 63) - 1
_ODD = np.uint64(0x9E3779B97F4A7C15)


def name_of(buf: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """64-bit names of the strings of `width` (8 or more) bytes that start at the given places."""
    n = len(buf) - 8
    h = np.zeros(len(at), np.uint64)
    for o in [*range(0, width - 8, 8), width - 8]:
        x = np.ndarray((n - o,), "<u8", buf.data, o, (1,))[at]
        h += x
        h *= _ODD
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def squeeze(q: np.ndarray) -> bytes:
    """Ascending numbers as differences, byte plane by byte plane."""
    d = np.diff(q, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())


def expand(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view(np.uint64), dtype=np.uint64)


def range_of(q: np.ndarray, bits: int, ranges: int) -> np.ndarray:
    return ((q >> np.uint64(bits - 32)) * np.uint64(ranges)) >> np.uint64(32)


class Plan:
    """Numbers that all passes share."""

    def __init__(self, least: int, total: int):
        if least < PERIOD + 7:
            raise ValueError(f"at least {PERIOD + 7} bytes")
        self.least, self.width = least, least - PERIOD + 1
        ranges = total / RANGE
        self.ranges = max(1, math.ceil(ranges / min(WIDEST, max(1.0, math.sqrt(ranges / MANY)))))
        # sampled names only choose what is looked at again: a few bits more than would tell them all apart
        self.bits = min(64, max(34, math.ceil(math.log2(max(2, total * len(COVER) / PERIOD))) + 10))


class Chunk:
    """The documents of a chunk, by doc_id, and what is known about them."""

    def __init__(self, plan: Plan, docs: pa.Table, side: pa.Table):
        self.plan = plan
        ids = np.concatenate([np.asarray(x.as_py(), np.int64) for x in docs.column("ids")] or [np.zeros(0, np.int64)])
        keys = np.concatenate([np.asarray(x.as_py(), np.int64) for x in docs.column("keys")] or [np.zeros(0, np.int64)])
        texts: list[bytes] = []
        for sizes, blob in zip(docs.column("sizes"), docs.column("blob"), strict=True):
            raw, at = zstandard.ZstdDecompressor().decompress(blob.as_py()), 0
            for n in sizes.as_py():
                texts.append(raw[at : at + n])
                at += n
            del raw
        order = self.order = np.lexsort([keys, ids])
        self.ids, self.texts = ids[order], [texts[k] for k in order]
        kind = side.column("kind").to_numpy()
        gone = set(zip(side.column("id").filter(pa.array(kind == 0)).to_pylist(), side.column("key").filter(pa.array(kind == 0)).to_pylist(), strict=True))
        self.copy = np.array([x in gone for x in zip(self.ids.tolist(), keys[order].tolist(), strict=True)], bool)
        self.own = np.nonzero(~self.copy)[0]
        parts = [self.texts[k] for k in self.own]
        self.size = np.array([len(x) for x in parts], np.int64)
        self.start = np.r_[0, np.cumsum(self.size)]
        self.buf = np.frombuffer(b"".join(parts) + bytes(80), np.uint8)
        self.number = np.unique(self.ids[self.own], return_inverse=True)[1].astype(np.int32)  # equal ids: one document
        self.side = {k: self._answers(side, kind == k) for k in (1, 2)}

    @staticmethod
    def _answers(side: pa.Table, at: np.ndarray) -> dict[int, bytes]:
        t = side.filter(pa.array(at))
        return dict(zip(t.column("r").to_pylist(), t.column("data").to_pylist(), strict=True))

    def parts(self) -> Iterator[tuple[int, int]]:
        """Runs of documents of about PART bytes: what is made for each byte is made for one run at a time."""
        if not len(self.size):
            return  # all texts of the chunk are copies
        cut = np.nonzero(np.diff(self.start[:-1] // PART, prepend=-1))[0]
        yield from zip(cut.tolist(), [*cut[1:].tolist(), len(self.size)], strict=True)

    def doc(self, at: np.ndarray) -> np.ndarray:
        return self.number[np.searchsorted(self.start[1:], at, side="right")]

    def _grouped(self, q: np.ndarray, at: np.ndarray):
        """The order of q, the heads of its runs, and the first and last document of each run."""
        order = np.argsort(q, kind="stable")
        s = q[order]
        head = np.nonzero(np.r_[True, s[1:] != s[:-1]])[0] if len(s) else np.zeros(0, np.int64)
        d = self.doc(at)[order]
        low, high = (np.minimum.reduceat(d, head), np.maximum.reduceat(d, head)) if len(head) else (d, d)
        return order, s[head], np.diff(np.r_[head, len(s)]), low, high

    def sample(self):
        cover = np.zeros(PERIOD, bool)
        cover[list(COVER)] = True
        found = [np.zeros(0, np.int64)]
        for a, b in self.parts():
            size = self.size[a:b].astype(np.int32)
            inside = np.arange(size.sum(), dtype=np.int32) - np.repeat(np.cumsum(size) - size, size)
            found.append(np.nonzero(cover[inside % PERIOD] & (inside + self.plan.width <= np.repeat(size, size)))[0] + self.start[a])
        at = np.concatenate(found)
        q = name_of(self.buf, at, self.plan.width)
        q >>= np.uint64(64 - self.plan.bits)
        return at, *self._grouped(q, at)

    def _told(self, names: np.ndarray, bits: int, kind: int) -> np.ndarray:
        """The answers of all ranges for ascending names."""
        out, r = np.zeros(len(names), bool), range_of(names, bits, self.plan.ranges)
        for k, a, b in _cuts(r):
            out[a:b] = np.unpackbits(np.frombuffer(self.side[kind][k], np.uint8), count=b - a).astype(bool)
        return out

    def dense(self):
        """The starts that have to be looked at, grouped by their names of full length."""
        at, order, names, count, low, high = self.sample()
        hit = np.zeros(len(at), bool)
        hit[order] = np.repeat(self._told(names, self.plan.bits, 1) | (low != high), count)
        seen = at[hit]
        del at, order, names, count, low, high, hit
        found = [np.zeros(0, np.int64)]
        for a, b in self.parts():
            own = seen[np.searchsorted(seen, self.start[a]) : np.searchsorted(seen, self.start[b])]
            if not len(own):
                continue
            edge = np.zeros(self.start[b] - self.start[a] + 1, np.int32)
            first = self.start[np.searchsorted(self.start, own, side="right") - 1]
            np.add.at(edge, np.maximum(own - PERIOD + 1, first) - self.start[a], 1)
            np.add.at(edge, own + 1 - self.start[a], -1)
            where = np.nonzero(np.cumsum(edge[:-1], dtype=np.int32))[0] + self.start[a]
            found.append(where[where + self.plan.least <= self.start[np.searchsorted(self.start, where, side="right")]])
        where = np.concatenate(found)
        return where, *self._grouped(name_of(self.buf, where, self.plan.least), where)

    def covered(self) -> np.ndarray:
        """For each byte of the documents that are no copies: whether it is removed."""
        at, order, names, count, low, _ = self.dense()
        gone = np.zeros(len(at), bool)
        gone[order] = np.repeat(self._told(names, 64, 2), count)
        first = np.zeros(len(at), np.int32)
        first[order] = np.repeat(low, count)
        start = at[gone | (self.doc(at) > first)]
        del at, order, names, count, low, gone, first
        out = np.zeros(len(self.buf) - 80, bool)
        for a, b in self.parts():
            low, high = self.start[a], self.start[b]
            own = start[np.searchsorted(start, low) : np.searchsorted(start, high)] - low
            if len(own):
                edge = np.zeros(high - low + 1, np.int32)
                np.add.at(edge, own, 1)
                np.add.at(edge, own + self.plan.least, -1)
                out[low:high] = np.cumsum(edge[:-1], dtype=np.int32) > 0
        return out

    def left(self) -> Iterator[tuple[np.ndarray | None, bytes]]:
        """For each document what is removed (None: all or nothing) and what stays."""
        gone, at = self.covered(), 0
        size = iter(self.size.tolist())
        for copy, text in zip(self.copy.tolist(), self.texts, strict=True):
            if copy:
                yield None, b"" if len(text) >= self.plan.least else text
                continue
            own = gone[at : at + (step := next(size))]
            at += step
            yield (own, np.frombuffer(text, np.uint8)[~own].tobytes()) if own.any() else (None, text)


def _cuts(r: np.ndarray) -> Iterator[tuple[int, int, int]]:
    if len(r):
        head = np.nonzero(np.r_[True, r[1:] != r[:-1]])[0]
        yield from zip(r[head].tolist(), head.tolist(), [*head[1:].tolist(), len(r)], strict=True)


_SENT = pa.schema([("chunk", pa.int32()), ("r", pa.int32()), ("data", pa.binary())])
SENT = "chunk int, r int, data binary"


def _sender(plan: Plan, full: bool):
    def run(key, docs: pa.Table, side: pa.Table) -> pa.Table:
        c = Chunk(plan, docs, side)
        names = (c.dense() if full else c.sample())[2]
        cuts = list(_cuts(range_of(names, 64 if full else plan.bits, plan.ranges)))
        out = pa.table({"chunk": [key[0].as_py()] * len(cuts), "r": [k for k, _, _ in cuts], "data": [squeeze(names[a:b]) for _, a, b in cuts]}, schema=_SENT)
        del c, names
        trim()
        return out

    return run


class Cuts:
    """Which chunk a row is in. Buckets of ids, each up to its anchor; a bucket has a number of chunks: parts of its ids in order, or, if it holds one id alone, of its rows."""

    def __init__(self, anchors: np.ndarray, chunks: np.ndarray, alone: np.ndarray):
        self.anchors, self.chunks, self.alone = anchors, chunks, alone
        self.first = np.cumsum(chunks) - chunks
        self.below = np.r_[anchors[:1] - 1 if len(anchors) and chunks[0] < 2 else [np.iinfo(np.int64).min // 4], anchors[:-1]].astype(np.int64) if len(anchors) else anchors

    def of(self, ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
        b = np.minimum(np.searchsorted(self.anchors, ids, side="left"), len(self.anchors) - 1)
        n, low = self.chunks[b], self.below[b]
        wide = np.maximum(self.anchors[b].astype(np.float64) - low, 1)
        part = np.clip((n * ((ids.astype(np.float64) - low - 1) / wide)).astype(np.int64), 0, n - 1)  # grows with the id
        return (self.first[b] + np.where(self.alone[b], (keys & 0x7FFFFFFF) % n, part)).astype(np.int32)

    def rank(self, chunk: np.ndarray) -> np.ndarray:
        """Chunks of one id have one rank."""
        b = np.searchsorted(self.first, chunk, side="right") - 1
        return np.where(self.alone[b], self.first[b], chunk)


def cut(rows: DataFrame) -> Cuts:
    """Chunks for rows (id, text). Only quantiles of ids and sums of their buckets come to the driver."""
    least, most, n, total = rows.agg(F.min("id"), F.max("id"), F.count("*"), F.sum(F.octet_length("text"))).first()
    if not n:
        return Cuts(np.array([LAST]), np.array([1]), np.array([False]))
    want = min(ANCHORS, math.ceil((total or 0) / CHUNK) * 4)
    found = rows.agg(F.percentile_approx("id", [k / want for k in range(1, want)], 10 * ANCHORS)).first()[0] if want > 1 else []
    anchors, times = np.unique(np.array(found or [], np.int64), return_counts=True)
    often = sorted({*anchors[times > 1].tolist(), LAST})
    heavy = rows.where(F.col("id").isin(often)).groupBy("id").agg(F.sum(F.octet_length("text")).alias("n")).where(F.col("n") > CHUNK).select("id").collect()
    alone = np.array(sorted(r["id"] for r in heavy), np.int64)
    anchors = np.unique(np.r_[anchors, alone, alone - 1, LAST])
    anchors = anchors[np.searchsorted(anchors, least) :]

    def bucket(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = np.zeros(len(anchors), np.int64)
        for b in it:
            size += np.bincount(np.searchsorted(anchors, b.column(0).to_numpy(), side="left"), b.column(1).to_numpy(), len(anchors)).astype(np.int64)
        at = np.nonzero(size)[0]
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int32()), "n": size[at]})

    size = np.zeros(len(anchors), np.int64)
    for r in rows.select("id", F.octet_length("text").cast("long").alias("n")).mapInArrow(bucket, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        size[r["bucket"]] = r["n"]
    own = np.isin(anchors, alone)
    keep, chunks, run = [], [], 0
    for k in range(len(anchors)):  # buckets that are small together are one
        run += int(size[k])
        if own[k] or k + 1 == len(anchors) or own[k + 1] or run + int(size[k + 1]) > CHUNK:
            keep.append(k)
            chunks.append(max(1, math.ceil(run / CHUNK)))
            run = 0
    return Cuts(anchors[keep], np.array(chunks), own[keep])


def _answer(full: bool, cuts: Cuts):
    """For each chunk's names of a range: whether another chunk has it (full: one of a lower rank)."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("chunk")
        parts = [expand(x.as_py()) for x in t.column("data")]
        q = np.concatenate(parts)
        if full:
            order = np.argsort(q, kind="stable")  # equal names stay in the order of their chunks
            s, rank = q[order], np.repeat(cuts.rank(t.column("chunk").to_numpy()), list(map(len, parts)))[order]
            head = np.maximum.accumulate(np.where(np.r_[True, s[1:] != s[:-1]], np.arange(len(s)), 0))
            told = np.empty(len(q), bool)
            told[order] = rank > rank[head]
            del rank, head
        else:
            s = np.sort(q)
            twice = np.unique(s[1:][s[1:] == s[:-1]])
            spot = np.searchsorted(twice, q)
            told = np.r_[twice, np.uint64(0)][spot] == q if len(twice) else np.zeros(len(q), bool)
            told &= spot < len(twice)
        ends = np.cumsum([len(p) for p in parts])
        data = [np.packbits(told[b - len(p) : b]).tobytes() for p, b in zip(parts, ends, strict=True)]
        del parts, q, told
        trim()
        return pa.table({"chunk": t.column("chunk"), "r": t.column("r"), "data": data}, schema=_SENT)

    return run


def _rewritten(plan: Plan, at: int, names: list[str]):
    """The rows themselves, with what is left of their text. at: the place of the text among the columns."""

    def run(key, docs, side):
        c = Chunk(plan, docs, side)
        rest = pa.concat_tables([pa.ipc.open_stream(x.as_py()).read_all() for x in docs.column("rest")]).take(pa.array(c.order))
        kept = pa.array([t.decode("utf-8", "ignore") for _, t in c.left()], pa.string())
        del c
        trim()
        return rest.add_column(at, "text", kept).select(names)

    return run


def _results(plan: Plan, texts: bool):
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.binary())] * texts

    def run(key, docs: pa.Table, side: pa.Table) -> pa.Table:
        c, rows = Chunk(plan, docs, side), []
        for i, text, (own, kept) in zip(c.ids.tolist(), c.texts, c.left(), strict=True):
            n = len(text) - len(kept)
            spans = 0 if not n else 1 if own is None else int(own[0]) + int((own[1:] & ~own[:-1]).sum())
            rows.append((None if i == LAST else i, len(text), n, spans, hashlib.sha256(kept).hexdigest(), *((kept,) if texts else ())))
        cols = list(zip(*rows, strict=True)) or [()] * len(fields)
        return pa.table([pa.array(x, t) for x, (_, t) in zip(cols, fields, strict=True)], schema=pa.schema(fields))

    return run


def _dealer(cuts: Cuts):
    """Documents of a batch by chunk: ids, keys (hash of the text), sizes and the joined texts."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for b in it:
            ids, keys = b.column(0).to_numpy(), b.column(1).to_numpy()
            chunk = cuts.of(ids, keys)
            order = np.argsort(chunk, kind="stable")
            texts = b.column(2)
            for c, a, z in _cuts(chunk[order]):
                own = order[a:z]
                parts = [texts[k].as_py() for k in own.tolist()]
                extra = {}
                if b.num_columns > 3:
                    sink = pa.BufferOutputStream()
                    part = pa.Table.from_batches([b]).drop_columns(b.schema.names[:3]).take(pa.array(own)).combine_chunks()
                    with pa.ipc.new_stream(sink, part.schema) as w:
                        w.write_table(part)
                    extra["rest"] = pa.array([sink.getvalue().to_pybytes()], pa.binary())
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([c], pa.int32()), "ids": pa.array([ids[own]], pa.list_(pa.int64())), "keys": pa.array([keys[own]], pa.list_(pa.int64())), "sizes": pa.array([[len(x) for x in parts]], pa.list_(pa.int32())), "blob": pa.array([press.compress(b"".join(parts))], pa.binary())} | extra)

    return run


def _chunk_of(cuts: Cuts):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            chunk = cuts.of(b.column(0).to_numpy(), b.column(1).to_numpy())
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(chunk, pa.int32()), "id": b.column(0), "key": b.column(1)})

    return run


def remove_repeats(docs: DataFrame, least: int = 50, texts: bool = False, rewrite: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with texts also kept (binary): every byte is removed that a string of `least` bytes covers
    which also starts in a document with a smaller doc_id. rewrite: instead the rows of docs with all their columns and what is left of the text
    (what a cut leaves of a character is dropped)."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    plan = Plan(least, total)
    cuts = cut(rows)
    body = F.coalesce("text", F.lit("")).cast("binary")
    rest = [F.col(c) for c in docs.columns if c != "text"] if rewrite else []
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_id"), F.xxhash64(body).alias("_key"), body.alias("_text"), *rest)
    dealt = keyed.mapInArrow(_dealer(cuts), "chunk int, ids array<long>, keys array<long>, sizes array<int>, blob binary" + ", rest binary" * rewrite)

    sums = rows.select("id", F.xxhash64("text").alias("key"), F.md5("text").alias("sum"))
    first = sums.groupBy("sum").agg(F.min("id").alias("first"), F.max("id").alias("most")).where("first < most")
    first = stored(first, "first")  # apart from the join, so that a large group of copies can be split there
    copies = sums.join(first, "sum").where("id > first").select("id", "key")
    copies = copies.mapInArrow(_chunk_of(cuts), "chunk int, id long, key long")
    empty = {"kind": F.lit(0), "r": F.lit(0), "data": F.lit(None).cast("binary")}
    side = stored(copies.select("chunk", *(v.alias(k) for k, v in empty.items()), "id", "key"), "copies")
    discard(first)

    def told(answers: DataFrame, kind: int) -> DataFrame:
        return answers.select("chunk", F.lit(kind).alias("kind"), "r", "data", F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("key"))

    def together(other: DataFrame):
        return dealt.groupBy("chunk").cogroup(other.groupBy("chunk"))

    for kind, full in ((1, False), (2, True)):
        sent = together(side).applyInArrow(_sender(plan, full), SENT)
        side = side.unionByName(told(sent.groupBy("r").applyInArrow(_answer(full, cuts), SENT), kind))
    if rewrite:
        return together(side).applyInArrow(_rewritten(plan, docs.columns.index("text"), docs.columns), docs.schema)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts
    return together(side).applyInArrow(_results(plan, texts), schema)
