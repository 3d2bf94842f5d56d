"""Packing of token sequences by vector bin packing.

Each example is a vector - tokens, segments, loss-bearing tokens - and each sequence has a limit on all three. A sequence is filled
by the dot-product rule: of the waiting examples that still fit, the one with the largest dot product of its vector with the room
left (both as shares of the limits) goes in. Examples may be cut: whole multiples of the sequence length leave first, and when
nothing fits, the best example is cut to fill the rest. A sequence that must close early is cut into powers of two, which need no
padding. Examples wait in a pool of bounded size, one pool for each input partition; no shuffle, nothing is dropped, and since a
partition is packed in its row order, a task that runs again makes the same rows.

Defined results: null text is empty; an empty document is its end token alone; repeated rows and ids are packed once each; a null
doc_id is kept; extra columns are not read; an empty table gives no rows."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import read_ranks
from .common import texts_of


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 256
    loss_tokens: int = 2048
    pool: int = 1024


class Pool:
    """Waiting examples. Each is cut from its front: [start, end) of its ids is left; tokens from `quiet` on bear loss."""

    def __init__(self, limits: Limits):
        self.limits, self.free = limits, list(range(limits.pool))[::-1]
        self.ids: list[tuple | None] = [None] * limits.pool
        self.start, self.end, self.quiet = (np.zeros(limits.pool, np.int64) for _ in range(3))
        self.used = np.zeros(limits.pool, bool)

    def __len__(self) -> int:
        return self.limits.pool - len(self.free)

    def add(self, key: tuple, start: int, end: int, quiet: int) -> None:
        k = self.free.pop()
        self.ids[k], self.start[k], self.end[k], self.quiet[k], self.used[k] = key, start, end, quiet, True

    def take(self, k: int, n: int) -> tuple:
        """The first n tokens left of example k, as a piece (key, start, length)."""
        piece = (self.ids[k], int(self.start[k]), n)
        self.start[k] += n
        if self.start[k] == self.end[k]:
            self.ids[k], self.used[k] = None, False
            self.free.append(k)
        return piece

    def best(self, room: np.ndarray, whole: bool) -> tuple[int, int, int] | None:
        """The example of the largest dot product with the room: (its slot, tokens that go in, of these loss-bearing). whole: only such as fit uncut."""
        at = np.nonzero(self.used)[0]
        if not len(at) or (room <= 0).any():
            return None
        start, end, quiet = self.start[at], self.end[at], self.quiet[at]
        n = end - start
        loss = end - np.maximum(start, np.minimum(quiet, end))
        if whole:
            ok = (n <= room[0]) & (loss <= room[2])
            if not ok.any():
                return None
            at, n, loss = at[ok], n[ok], loss[ok]
        else:  # as much of each as the room takes
            n = np.minimum(np.minimum(n, room[0]), np.maximum(quiet - start, 0) + room[2])
            loss = np.maximum(start + n - np.maximum(quiet, start), 0)
        lim = self.limits
        dot = n / lim.tokens * (room[0] / lim.tokens) + room[1] / lim.segments / lim.segments + loss / lim.loss_tokens * (room[2] / lim.loss_tokens)
        k = int(np.argmax(dot))
        return int(at[k]), int(n[k]), int(loss[k])


def powers(pieces: list[tuple]) -> Iterator[list[tuple]]:
    """Pieces cut into sequences whose lengths are powers of two, the largest first."""
    left = sum(p[2] for p in pieces)
    todo = list(reversed(pieces))
    while left:
        size = want = 1 << (left.bit_length() - 1)
        seq = []
        while want:
            key, start, n = todo.pop()
            seq.append((key, start, min(n, want)))
            if n > want:
                todo.append((key, start + want, n - want))
            want -= min(n, want)
        yield seq
        left -= size


def pack(examples: Iterator[tuple], limits: Limits) -> Iterator[list[tuple]]:
    """Sequences of pieces (key, start, length) for examples (key, tokens, quiet); quiet: so many tokens at its front bear no loss."""
    pool = Pool(limits)

    def fill() -> Iterator[list[tuple]]:
        room, seq = np.array([limits.tokens, limits.segments, limits.loss_tokens], np.int64), []
        while (room > 0).all() and len(pool):
            # the last segment must use up the room, so it may be a cut one
            found = (pool.best(room, True) if room[1] > 1 else None) or pool.best(room, False)
            if found is None or found[1] <= 0:
                break
            k, n, loss = found
            seq.append(pool.take(k, n))
            room -= (n, 1, loss)
        if seq:
            yield from [seq] if room[0] == 0 else powers(seq)

    for key, n, quiet in examples:
        start = 0
        while n - start >= limits.tokens and min(n, start + limits.tokens) - max(min(quiet, n), start) <= limits.loss_tokens:
            yield [(key, start, limits.tokens)]
            start += limits.tokens
        if start < n:
            while not pool.free:
                yield from fill()
            pool.add(key, start, n, quiet)
    while len(pool):
        yield from fill()


@functools.cache
def _tokenizer(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


def encode_with(path: str, pattern: str, end: int) -> Callable[[str], tuple[np.ndarray, int]]:
    """A text to its ids and the end id, all loss-bearing. path: the ranks of a byte-level vocabulary."""

    def encode(text: str) -> tuple[np.ndarray, int]:
        ids = _tokenizer(path, pattern).encode_ordinary(text)
        ids.append(end)
        return np.array(ids, "<u4"), 0

    return encode


FIELDS = [("doc_id", pa.int64()), *((k, pa.int64()) for k in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "loss_tokens"))]


def pack_texts(docs: DataFrame, encode: Callable[[str], tuple[np.ndarray, int]], limits: Limits = Limits(), ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens (of its sequence),
    loss_tokens (of the piece); with ids, also its ids. encode(text) -> (ids as uint32, how many at the front bear no loss)."""
    schema = pa.schema(FIELDS + [("ids", pa.list_(pa.int64()))] * ids)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def examples():
            for b in it:
                for doc, text in zip(b.column(0).to_pylist(), texts_of(b), strict=True):
                    got, quiet = encode(text)
                    yield (doc, got, quiet), len(got), quiet

        rows: list[tuple] = []
        for k, seq in enumerate(pack(examples(), limits)):
            offset, total = 0, sum(p[2] for p in seq)
            for (doc, got, quiet), start, n in seq:
                own = got[start : start + n]
                rows.append((doc, start, n, zlib.crc32(own.tobytes()), len(got), (part << 40) + k, offset, total, max(0, start + n - max(start, quiet)), *([own.astype(np.int64)] if ids else ())))
                offset += n
            if len(rows) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    names = ", ".join(f"{k} long" for k, _ in FIELDS) + ", ids array<long>" * ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, names)
