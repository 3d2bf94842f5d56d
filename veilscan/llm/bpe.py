"""Byte-level BPE encoding and decoding by finite-state machines.

The merges (ranks) are compiled into a transducer whose states are made when first reached. A state holds every place at which
a longer token could still have begun, with the trie node of the bytes since then and the token before it; a step on a byte finds
the one token that can end there. What the trails back from all these places share is certain and is emitted: a token leaves after
a lookahead bounded by the longest token, and one step costs one table lookup once its state is known. Two neighbouring tokens can
stand in an encoding if replaying the merges along their facing edges joins nothing across the border; a sequence is the encoding
of its bytes if that holds for each pair.

Decoding maps ids to bytes and runs an incremental UTF-8 machine, on whole tokens at a time, with memory of one state between calls.

Defined results: null text is empty; empty text has no tokens and the digests of the empty string; text in Arrow is valid UTF-8,
so decoding returns the text's own bytes; repeated rows stay; extra columns are not read."""

from __future__ import annotations

import array
import base64
import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, texts_of

_NEVER = 1 << 60


class Merges:
    """Ranks, and what the transducer asks of them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.bytes = ranks, {v: k for k, v in ranks.items()}
        self.known: dict[tuple[int, int], bool] = {}
        self._edges: dict[int, tuple[tuple, tuple]] = {}

    def merge(self, piece: bytes) -> list[bytes]:
        """Plain merging: the neighbours of the lowest joint rank first, the leftmost of equals."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1))
            if rank == _NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def edges(self, token: int) -> tuple[tuple, tuple]:
        """The tokens that stood at the left edge and at the right edge while this one was merged, oldest first; ((), ()) if merging never makes it."""
        if (got := self._edges.get(token)) is None:
            got = self._edges[token] = self._edges_of(self.bytes[token])
        return got

    def _edges_of(self, b: bytes) -> tuple[tuple, tuple]:
        if len(b) == 1:
            return (b,), (b,)
        parts = [b[i : i + 1] for i in range(len(b))]
        left, right = [parts[0]], [parts[-1]]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1))
            if rank == _NEVER:
                return (), ()
            if at == len(parts) - 2:
                right.append(parts[at] + parts[at + 1])
            if at == 0:
                left.append(parts[0] + parts[1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(left), tuple(right)

    def follows(self, a: int, b: int) -> bool:
        """Whether b can follow a in an encoding (a < 0: stand first)."""
        if (got := self.known.get((a, b))) is None:
            if len(self.known) > 500_000:
                self.known.clear()
            got = self.known[a, b] = self._follows(a, b)
        return got

    def _follows(self, a: int, b: int) -> bool:
        left = self.edges(b)[0]
        if a < 0 or not left:
            return bool(left)
        right, rank = self.edges(a)[1], self.ranks.get
        i = j = 0
        while True:
            across = rank(right[i] + left[j], _NEVER)
            grow_a = rank(right[i + 1]) if i + 1 < len(right) else _NEVER
            grow_b = rank(left[j + 1]) if j + 1 < len(left) else _NEVER
            if across < grow_a and across <= grow_b and across != _NEVER:  # of equal ranks the leftmost pair is merged first
                return False
            if grow_a == grow_b == _NEVER:
                return True
            if grow_a <= grow_b:
                i += 1
            else:
                j += 1


class Transducer:
    """Lazily determinised encoder of single pieces of text.

    A state is the set of live places: (trie node of the bytes since there, last token of the text up to there). Each step on a byte
    writes the token that ends there; where the trails back from all live places meet, everything before is certain and is emitted."""

    #: Bytes after which the certain tokens of a long piece are emitted.
    SETTLE = 4096

    def __init__(self, ranks: dict[bytes, int], states: int = 350_000):
        self.merges, self.most = Merges(ranks), states
        self.trie: list[dict[int, int]] = [{}]
        self.token, self.depth = [-1], [0]
        self.size = [0] * (max(ranks.values()) + 1)
        for b, t in ranks.items():
            self.size[t], node = len(b), 0
            for x in b:
                nxt = self.trie[node].get(x)
                if nxt is None:
                    nxt = self.trie[node][x] = len(self.trie)
                    self.trie.append({})
                    self.token.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = nxt
            self.token[node] = t
        self._reset()

    def _reset(self) -> None:
        start = ((0, -1),)
        self.states, self.ids, self.moves = [start], {start: 0}, [{}]

    def _move(self, s: int, x: int) -> tuple[int, int]:
        """The state after s on byte x, and the token that ends with x."""
        trie, token, known = self.trie, self.token, self.merges.known
        live, new = [], -1
        for item in self.states[s]:
            nxt = trie[item[0]].get(x)
            if nxt is None:
                continue
            last = item[1]
            if new < 0 and (t := token[nxt]) >= 0:
                pair = last, t
                if known[pair] if pair in known else self.merges.follows(last, t):
                    new = t
            if trie[nxt]:
                live.append((nxt, last))
        if new < 0:
            raise ValueError("the vocabulary lacks a byte")
        live.append((0, new))
        state = tuple(live)
        if (k := self.ids.get(state)) is None:
            k = self.ids[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
        step = self.moves[s][x] = k, new
        return step

    def _trail(self, ends: list[int], at: int, low: int = 0) -> list[int]:
        """The tokens up to place `at`, backwards from there, down to place `low`."""
        out, size = [], self.size
        while at > low:
            t = ends[at - 1]
            out.append(t)
            at -= size[t]
        return out

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one piece; a piece that is a token itself is that token."""
        if (whole := self.merges.ranks.get(piece)) is not None:
            return [whole]
        if len(self.states) > self.most:  # memory stays bounded; states are made again when needed
            self._reset()
        out: list[int] = []
        for tokens in self.stream([piece]):
            out += tokens
        return out

    def stream(self, chunks: Iterable[bytes]) -> Iterator[list[int]]:
        """The ids of a piece that comes in chunks, each list as soon as it is certain."""
        s, moves, ends = 0, self.moves, []
        for piece in chunks:
            for x in piece:
                step = moves[s].get(x)
                s, t = step if step is not None else self._move(s, x)
                ends.append(t)
                if len(ends) >= self.SETTLE:
                    places = {len(ends) - self.depth[node] for node, _ in self.states[s]}
                    while len(places) > 1:  # the trails meet at most a few tokens back
                        far = max(places)
                        places.remove(far)
                        places.add(far - self.size[ends[far - 1]])
                    if sure := places.pop():
                        yield self._trail(ends, sure)[::-1]
                        del ends[:sure]
        if ends:
            yield self._trail(ends, len(ends))[::-1]


class Kept(dict):
    """A memo of make(key) that keeps between `most` and twice as many entries: those used lately."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = got
        return got


class Encoder:
    """Texts to packed ids. A text is cut before single spaces that follow other text - no match of the pattern crosses these -
    and the ids of short segments and pieces used lately are kept."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most: int = 400_000):
        self.machine, self.find = Transducer(ranks), regex.compile(pattern).findall
        self.pieces, self.segments = Kept(self._piece, most // 2), Kept(self._segment, most)

    def _piece(self, piece: str) -> bytes:
        return array.array("I", self.machine.encode(piece.encode())).tobytes()

    def whole(self, text: str) -> bytes:
        return b"".join([self.pieces[x] if len(x) <= 48 else self._piece(x) for x in self.find(text)])

    def _segment(self, segment: str) -> bytes:
        if not segment or segment[-1].isspace():
            raise LookupError  # the space after it may belong to it
        return self.whole(" " + segment)

    def encode(self, text: str) -> np.ndarray:
        first, *rest = text.split(" ")
        try:
            if not first or first[-1].isspace():
                raise LookupError
            packed = self.whole(first) + b"".join(map(self.segments.__getitem__, rest))
        except LookupError:
            packed = self._joined(first, rest)
        return np.frombuffer(packed, "<u4")

    def _joined(self, held: str, rest: list[str]) -> bytes:
        """As encode, where spaces follow white space: such segments stay together."""
        out, head = [], True
        parts = [held]
        for x in [*rest, None]:
            if x is not None and (not parts[-1] or parts[-1][-1].isspace()):
                parts.append(x)
                continue
            seg = " ".join(parts)
            out.append(self.whole(seg) if head else self.segments[seg] if 0 < len(seg) <= 64 and not seg[-1].isspace() else self.whole(" " + seg))
            head, parts = False, [x]
        return b"".join(out)


#: The states of the UTF-8 machine: what may come next. 0 accepts; 1 to 3: so many plain continuation bytes; then the limited ones after E0, ED, F0, F4; 8 rejects.
_AFTER = {(0xC2, 0xDF): 1, (0xE0, 0xE0): 4, (0xE1, 0xEC): 2, (0xED, 0xED): 5, (0xEE, 0xEF): 2, (0xF0, 0xF0): 6, (0xF1, 0xF3): 3, (0xF4, 0xF4): 7}
_MORE = {1: (0x80, 0xBF, 0), 2: (0x80, 0xBF, 1), 3: (0x80, 0xBF, 2), 4: (0xA0, 0xBF, 1), 5: (0x80, 0x9F, 1), 6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2)}
REJECT = 8


@functools.cache
def utf8_table() -> list[list[int]]:
    t = [[REJECT] * 256 for _ in range(9)]
    t[0][:128] = [0] * 128
    for (a, b), s in _AFTER.items():
        t[0][a : b + 1] = [s] * (b + 1 - a)
    for s, (a, b, nxt) in _MORE.items():
        t[s][a : b + 1] = [nxt] * (b + 1 - a)
    return t


class Decoder:
    """Streaming decoder: feed() ids, get the text that is complete so far; finish() tells whether the stream ended cleanly."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for b, t in ranks.items():
            self.bytes[t] = b
        self.decimal = [b",%d" % t for t in range(len(self.bytes))]
        self.plain = np.array([self._run(0, b) == 0 for b in self.bytes])
        self._steps: dict[tuple[int, int], int] = {}
        self.reset()

    def reset(self) -> None:
        self.state, self._held = 0, b""

    @staticmethod
    def _run(state: int, b: bytes) -> int:
        t = utf8_table()
        for x in b:
            state = t[state][x]
        return state

    def advance(self, ids: np.ndarray) -> None:
        """Moves the machine over ids. Tokens that are whole characters leave state 0 as it is, so only the others are followed."""
        odd = np.nonzero(~self.plain[ids])[0]
        at, n = 0, len(ids)
        while at < n:
            if self.state == 0:
                k = int(np.searchsorted(odd, at))
                if k == len(odd):
                    return
                at = int(odd[k])
            key = (self.state, int(ids[at]))
            if (s := self._steps.get(key)) is None:
                s = self._steps[key] = self._run(self.state, self.bytes[key[1]])
            self.state = s
            if s == REJECT:
                return
            at += 1

    def raw(self, ids: np.ndarray) -> bytes:
        self.advance(ids)
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))

    def feed(self, ids: Iterable[int]) -> str:
        got = self._held + self.raw(np.asarray(list(ids), np.int64))
        if self.state == REJECT:
            raise ValueError("not UTF-8")
        keep = 0
        if self.state:  # an unfinished character: from its lead byte on
            keep = next(k for k in range(1, 5) if got[-k] >= 0xC0)
        self._held = got[len(got) - keep :]
        return got[: len(got) - keep].decode()

    def finish(self) -> bool:
        return self.state == 0


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


@functools.cache
def _coder(path: str, pattern: str) -> tuple[Encoder, Decoder]:
    """One for each worker process."""
    ranks = read_ranks(path)
    return Encoder(ranks, pattern), Decoder(ranks)


def encode_texts(docs: DataFrame, path: str, pattern: str, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes, valid_utf8; with ids, also the ids as array<int>."""

    def rows(b: pa.RecordBatch) -> dict:
        enc, dec = _coder(path, pattern)
        n, hashes, texts, sizes, valid, all_ids = [], [], [], [], [], []
        for text in texts_of(b):
            got = enc.encode(text)
            n.append(len(got))
            dec.reset()
            dec.advance(got)
            row = got.tolist()
            hashes.append(hashlib.sha256(b"".join(map(dec.decimal.__getitem__, row))[1:]).hexdigest())
            raw = b"".join(map(dec.bytes.__getitem__, row))
            texts.append(hashlib.sha256(raw).hexdigest())
            sizes.append(len(raw))
            valid.append(dec.finish())
            if ids:
                all_ids.append(got.astype(np.int32))
        out = {"doc_id": b.column(0), "n_tokens": n, "ids_sha256": hashes, "decoded_sha256": texts, "n_bytes": sizes, "valid_utf8": valid}
        return out | ({"ids": all_ids} if ids else {})

    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("n_bytes", pa.int64()), ("valid_utf8", pa.bool_())]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, valid_utf8 boolean" + ", ids array<int>" * ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(batches(rows, pa.schema(fields + [("ids", pa.list_(pa.int32()))] * ids)), schema)


def decode_ids(rows: DataFrame, path: str) -> DataFrame:
    """doc_id, text of rows (doc_id, ids array<int>); ids that aren't UTF-8 together give a null text."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = Decoder(read_ranks(path))
        for b in it:
            out = []
            for x in b.column(1):
                dec.reset()
                raw = dec.raw(np.array(x.as_py() or [], np.int64))
                out.append(raw.decode() if dec.finish() else None)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "text": pa.array(out, pa.string())})

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
