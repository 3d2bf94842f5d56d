"""Approximate nearest neighbours by collision counting over query-centred windows.

Inner products become distances by one more component: among rows of like norm (a kind: within a fifth, of one length), of largest norm M, a row x gets sqrt(M * M - x.x), a
query 0. Rows of a kind are dealt into cells by the signs of their first projections, and a large cell into blocks by a hash, so that a block is bounded whatever the
vectors. A block sorts its rows on each of `projections` random lines. A query opens a window around its own place on every line and widens all of them (virtual
rehashing); a row that lies in `collisions` windows or more is verified. The windows are wide enough once a row as far as the k-th best would collide often enough with
probability `sure`.

1. Each block searches for the queries among its own rows, so that every query has a k-th best, and tells how far its rows reach on every line.
2. A query goes to the other blocks in whose reach its windows, of the width that its k-th best asks for, meet on `collisions` lines or more - no row elsewhere could be
   verified - and whose norms can still give the k-th best. There one window of that width is enough.
3. The blocks' best are merged by exact score.

Only queries are sent about, rows are dealt once. What the driver and every task hold is a range for each line and cell, at most 2 ** `bits` cells of a kind.

Defined results: rows whose vec_id is null or whose vector is null, empty, zero or holds null or non-finite components take no part; a vec_id that
occurs twice counts once, with the smaller vector; vectors only meet those of their own length; fewer candidates than k are all
returned; ties go to the smaller vec_id; extra columns are not read; an empty table gives no rows."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, stored


@dataclass(frozen=True)
class Settings:
    projections: int = 64
    collisions: int = 6
    sure: float = 0.95
    widen: float = 1.25
    block: int = 16384
    bits: int = 16
    seed: int = 11

    def lines(self, dim: int) -> np.ndarray:
        """Random lines for vectors of one length and the component that comes to them."""
        return np.random.default_rng((self.seed, dim)).standard_normal((dim + 1, self.projections))

    @property
    def reach(self) -> float:
        return enough(self.projections, self.collisions, self.sure)


def enough(m: int, least: int, sure: float) -> float:
    """Half a window's width, as a multiple of the distance, from which a row collides on `least` of m lines with probability `sure`."""
    low, high = 0.0, 1.0
    for _ in range(60):
        p = (low + high) / 2
        miss = sum(math.comb(m, k) * p**k * (1 - p) ** (m - k) for k in range(least))
        low, high = (low, p) if 1 - miss >= sure else (p, high)
    return NormalDist().inv_cdf((1 + high) / 2)


class Block:
    """Rows of one block with a sorted array for each line. largest: the largest norm of the kind."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, largest: float, s: Settings):
        self.ids, self.x, self.s, self.largest = ids, x, s, largest
        self.lines = s.lines(x.shape[1])
        rest = np.sqrt(np.maximum(largest**2 - np.einsum("ij,ij->i", x, x), 0))
        at = (x @ self.lines[:-1] + rest[:, None] * self.lines[-1]).T
        self.order = np.argsort(at, axis=1, kind="stable").astype(np.int32)
        self.place = np.take_along_axis(at, self.order, 1)
        self.rough = x.astype(np.float32)
        #: Entries of lines that fell into windows, rows that were verified, and how many there were to choose from.
        self.touched = self.verified = self.entries = self.rows = 0

    def windows(self, center: np.ndarray, half: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
        """First and last place of each query's window on each line (queries, lines)."""
        return tuple(np.stack([p.searchsorted(c + x * half, side) for p, c in zip(self.place, center.T, strict=True)], 1) for x, side in ((-1, "left"), (1, "right")))

    def search(self, q_ids: np.ndarray, q: np.ndarray, k: int, known: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query the ids of the best k and their scores. known: scores that k rows elsewhere reach (or -inf); one window suffices then."""
        center, norm = q @ self.lines[:-1], np.einsum("ij,ij->i", q, q)
        known = np.full(len(q), -np.inf) if known is None else known
        sure = np.isfinite(known)
        wide = self.s.reach * np.sqrt(np.maximum(norm + self.largest**2 - 2 * np.where(sure, known, 0), 0))
        low, high = self.windows(center, np.where(sure, wide, 0))
        steps: list[tuple[np.ndarray, np.ndarray]] = []  # windows of all queries that know nothing, at each width
        halves = [self._first(k)]
        for i in range(len(q)):
            count, seen = np.zeros(len(self.x), np.int64), self.ids == q_ids[i]
            found = np.zeros(0, np.int64), np.zeros(0, np.float32)
            a, b = low[i], high[i]
            if sure[i]:
                self._count(count, a, a, a, b)
                found = self._verify(count, seen, q[i], found)
            else:
                for r in range(10_000):
                    if r == len(steps):
                        halves.append(halves[-1] * self.s.widen)
                        steps.append(self.windows(center, halves[r]))
                    to_a, to_b = steps[r][0][i], steps[r][1][i]
                    self._count(count, to_a, a, b, to_b)
                    a, b, found = to_a, to_b, self._verify(count, seen, q[i], found)
                    if ((a == 0) & (b == len(self.x))).all():
                        break
                    if len(found[1]) >= k and self.s.reach * math.sqrt(max(norm[i] + self.largest**2 - 2 * float(np.partition(found[1], -k)[-k]), 0.0)) <= halves[r]:
                        break
            ids, scores = found
            self.touched, self.entries = self.touched + int((b - a).sum()), self.entries + self.order.size
            self.verified, self.rows = self.verified + len(ids), self.rows + len(self.x)
            if len(ids) > k:  # rounding of the rough scores cannot part these
                ids = ids[scores >= np.partition(scores, -k)[-k] - 1e-5 * max(1.0, math.sqrt(norm[i]) * self.largest)]
            exact = (self.x[ids] * q[i]).sum(1)
            best = np.lexsort([self.ids[ids], -exact])[:k]
            yield self.ids[ids[best]], exact[best]

    def _count(self, count: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> None:
        """Counts the rows in [a, b) and [c, d) of each line."""
        fresh = [self.order[j, x:y] for p, q in ((a.tolist(), b.tolist()), (c.tolist(), d.tolist())) for j, (x, y) in enumerate(zip(p, q, strict=True)) if x < y]
        if fresh:
            count += np.bincount(np.concatenate(fresh), minlength=len(count))

    def _verify(self, count: np.ndarray, seen: np.ndarray, q: np.ndarray, found: tuple) -> tuple:
        new = np.nonzero((count >= self.s.collisions) & ~seen)[0]
        seen[new] = True
        return (np.r_[found[0], new], np.r_[found[1], self.rough[new] @ q.astype(np.float32)]) if len(new) else found

    def _first(self, k: int) -> float:
        """Half the width of windows that hold about a fiftieth of the rows, or k."""
        n = len(self.x)
        step = min(n - 1, max(k, n // 50))
        return max(float(np.median(self.place[:, step:] - self.place[:, : n - step])) / 2, 1e-9 * self.largest)


KEY = ["dim", "scale", "cell", "sub"]
OUT = "query_id long, vec_id long, score double"
HOME = "query_id long, x array<double>, kth double, ids array<long>, scores array<double>, low array<double>, high array<double>, dim int, scale int, cell int, sub int"


def _matrix(t: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    ids = t.column(name).to_numpy()
    flat = t.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return ids, flat.reshape(len(ids), -1).astype(np.float64)


def _celled(bits: dict[tuple[int, int], int], s: Settings):
    """Rows (vec_id, x, asks, dim, scale) with their cell: the signs of the first projections."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            t, cell = pa.Table.from_batches([b]), np.zeros(b.num_rows, np.int32)
            dim, scale = t.column("dim").to_numpy(), t.column("scale").to_numpy()
            for d, z in set(zip(dim.tolist(), scale.tolist(), strict=True)):
                at = np.nonzero((dim == d) & (scale == z))[0]
                n = bits[d, z]
                if n:
                    _, x = _matrix(t.take(pa.array(at)), "vec_id")
                    cell[at] = (x @ s.lines(d)[:-1, :n] > 0) @ (1 << np.arange(n))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], names=[*b.schema.names, "cell"])

    return run


def _home(kinds: dict, k: int, s: Settings):
    def run(key, t):
        d, z, cell, sub = (x.as_py() for x in key)
        ids, x = _matrix(t, "vec_id")
        order = np.argsort(ids, kind="stable")
        ids, x, asks = ids[order], x[order], t.column("asks").to_numpy(zero_copy_only=False)[order]
        block = Block(ids, x, kinds[d, z], s)
        rows = [(int(i), v.tolist(), float(score[-1]) if len(score) == k else -math.inf, own.tolist(), score.tolist(), None, None) for i, v, (own, score) in zip(ids[asks], x[asks], block.search(ids[asks], x[asks], k), strict=True)]
        rows.append((None, None, None, None, None, block.place[:, 0].tolist(), block.place[:, -1].tolist()))
        kinds_of = [pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.list_(pa.int64()), *[pa.list_(pa.float64())] * 3]
        cols = [pa.array(c, f) for c, f in zip(zip(*rows, strict=True), kinds_of, strict=True)] + [pa.array([v] * len(rows), pa.int32()) for v in (d, z, cell, sub)]
        return pa.table(cols, names=[f.split()[0] for f in HOME.split(", ")])

    return run


def _routed(kinds: dict, cells: dict, s: Settings):
    """Where each query goes beside its own block. cells: by length of the vectors, a list of (scale, cells, blocks of each, low and high of each on every line)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for k in range(b.num_rows):
                row = b.slice(k, 1)
                i, x, kth, d, z, cell, sub = (row.column(j)[0].as_py() for j in range(7))
                q, to = np.array(x), []
                center, norm = q @ s.lines(d)[:-1] if d not in lines else q @ lines[d][:-1], float(q @ q)
                for scale, names, subs, low, high in cells[d]:
                    largest = kinds[d, scale]
                    if largest * math.sqrt(norm) * (1 + 1e-9) < kth:
                        continue
                    half = s.reach * math.sqrt(max(norm + largest**2 - 2 * kth, 0.0)) if math.isfinite(kth) else math.inf
                    meets = ((low <= center + half) & (high >= center - half)).sum(1) >= s.collisions
                    to += [(scale, c, j) for c, n in zip(names[meets].tolist(), subs[meets].tolist(), strict=True) for j in range(n) if (scale, c, j) != (z, cell, sub)]
                if to:
                    n, (scale, c, j) = len(to), zip(*to, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([i] * n, pa.int64()), pa.array([x] * n, pa.list_(pa.float64())), pa.array([kth] * n), *(pa.array(v, pa.int32()) for v in ([d] * n, scale, c, j))], names=["query_id", "x", "kth", *KEY])

    lines = {d: s.lines(d) for d in cells}
    return run


def _visited(kinds: dict, k: int, s: Settings):
    fields = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(key, rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not rows.num_rows or not asked.num_rows:
            return fields.empty_table()
        ids, x = _matrix(rows, "vec_id")
        order = np.argsort(ids, kind="stable")
        block = Block(ids[order], x[order], kinds[key[0].as_py(), key[1].as_py()], s)
        q_ids, q = _matrix(asked, "query_id")
        got = [(np.full(len(v), i), v, score) for i, (v, score) in zip(q_ids, block.search(q_ids, q, k, asked.column("kth").to_numpy()), strict=True)]
        return pa.table([np.concatenate(c) for c in zip(*got, strict=True)], schema=fields)

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, x array<double>) of the rows that take part, each vec_id once."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    bad = F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull()).where(~bad & F.exists("x", lambda e: e != 0))
    return v.groupBy("vec_id").agg(F.min("x").alias("x"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, settings: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id, score: for each row for which is_query (on vec_id) holds, the k other rows of the largest inner product."""
    s, norm = settings, F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, e: a + e * e))
    v = usable(vectors).withColumns({"dim": F.size("x"), "norm": norm, "asks": F.coalesce(is_query, F.lit(False))}).withColumn("scale", F.round(F.log("norm") / math.log(1.2)).cast("int"))
    v = stored(v.select("vec_id", "x", "asks", "dim", "scale", "norm"), "vectors")
    found = v.groupBy("dim", "scale").agg(F.count("*").alias("n"), F.max("norm").alias("largest")).collect()  # a few for each power of ten
    kinds = {(r["dim"], r["scale"]): r["largest"] for r in found}
    bits = {(r["dim"], r["scale"]): min(s.bits, max(0, math.ceil(math.log2(r["n"] / s.block)))) for r in found}
    rows = v.drop("norm").mapInArrow(_celled(bits, s), "vec_id long, x array<double>, asks boolean, dim int, scale int, cell int")
    size = rows.groupBy("dim", "scale", "cell").agg(F.ceil(F.count("*") / s.block).cast("int").alias("subs"))
    # at most 2 ** bits cells of a kind
    rows = stored(rows.join(F.broadcast(size), ["dim", "scale", "cell"]).withColumn("sub", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("subs")).cast("int")), "rows")
    discard(v)
    home = stored(rows.groupBy(*KEY).applyInArrow(_home(kinds, k, s), HOME), "home")

    told = home.where("query_id is null").select("dim", "scale", "cell", "sub", F.posexplode(F.arrays_zip("low", "high"))).select("dim", "scale", "cell", "sub", "pos", "col.*")
    told = told.groupBy("dim", "scale", "cell", "pos").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("sub").alias("sub"))
    told = told.groupBy("dim", "scale", "cell").agg(F.sort_array(F.collect_list(F.struct("pos", "low", "high"))).alias("r"), (F.max("sub") + 1).alias("subs"))
    cells = defaultdict(list)
    by = defaultdict(list)
    for r in told.collect():
        by[r["dim"], r["scale"]].append((r["cell"], r["subs"], [x["low"] for x in r["r"]], [x["high"] for x in r["r"]]))
    for (d, z), own in by.items():
        names, subs, low, high = (np.array(c) for c in zip(*own, strict=True))
        cells[d].append((z, names, subs, low, high))
    asked = home.where("query_id is not null")
    sent = asked.select("query_id", "x", "kth", *KEY).mapInArrow(_routed(kinds, dict(cells), s), "query_id long, x array<double>, kth double, dim int, scale int, cell int, sub int")
    other = rows.select("vec_id", "x", *KEY).groupBy(*KEY).cogroup(sent.groupBy(*KEY)).applyInArrow(_visited(kinds, k, s), OUT)
    own = asked.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("z")).select("query_id", F.col("z.ids").alias("vec_id"), F.col("z.scores").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return own.unionByName(other).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
