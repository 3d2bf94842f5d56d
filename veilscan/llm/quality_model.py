"""Quality classifier by compression.

Two zstandard dictionaries are trained, one from good and one from bad labelled text, on slices from all over each text. A text is compressed whole, in slices
that each start afresh, with either dictionary and with none; the difference of the sizes by its length tells which text it resembles. A
logistic calibration on labelled rows that built no dictionary, measured whole in the executors, turns that, with the sizes by length, into a score.

Defined results: null and empty texts get the score of a text without evidence; repeated rows get equal scores; a null doc_id counts as not held out;
extra columns are not read; with labels of one kind or none, the score is the share of good labels (0.5 without any)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, discard, labelled_sample, remainder, stored

SLICE = 2048
LEVEL = 3
#: Slices that a text gives to a dictionary, spread evenly over all of it; a bound on what the driver gathers.
SPREAD = 16


def slices(text: bytes) -> list[bytes]:
    return [text[k : k + SLICE] for k in range(0, len(text), SLICE)]


def spread(text: bytes) -> list[bytes]:
    parts = slices(text)
    return parts if len(parts) <= SPREAD else [parts[k * (len(parts) - 1) // (SPREAD - 1)] for k in range(SPREAD)]


def build_dictionary(parts: list[bytes], size: int) -> bytes:
    """A dictionary trained on slices; of too little text to train on, the text itself."""
    try:
        return zstandard.train_dictionary(size, parts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-size:]


@dataclass
class Model:
    good: bytes
    bad: bytes
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    prior: float

    def machines(self) -> list:
        frame = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        return [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), **frame) for d in (self.good, self.bad)] + [zstandard.ZstdCompressor(**frame)]

    @staticmethod
    def measure(machines: list, text: bytes) -> list[float]:
        """Difference of the compressed sizes, the size with the good dictionary and the size with none, all by length."""
        n, parts = max(len(text), 1), slices(text)
        good, bad, none = (sum(len(m.compress(p)) for p in parts) for m in machines)
        return [(bad - good) / n, good / n, none / n]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(x), self.prior)
        z = np.c_[(x - self.mean) / self.spread, np.ones(len(x))] @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def calibrate(model: Model, x: np.ndarray, y: np.ndarray) -> None:
    """Weights for measures x of rows of quality y: Newton's steps with a weak ridge."""
    model.mean, model.spread = x.mean(0), x.std(0) + 1e-9
    z, w = np.c_[(x - model.mean) / model.spread, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.05 * np.eye(len(w)), z.T @ (y - p) - 0.05 * w)
    model.weights = w


def builders(ids: list[tuple[int, int]]) -> tuple[set[int], set[int]]:
    """Of labelled ids (id, quality): those whose texts build the dictionaries, two of three, and those that calibrate. Of fewer than three of a quality all do both."""
    by = {q: sorted(i for i, k in ids if k == q) for q in (0, 1)}
    return tuple({i for own in by.values() for k, i in enumerate(own) if (k % 3 == 0) != build or len(own) < 3} for build in (True, False))


def train(docs: DataFrame, labels: DataFrame, held_out: int = 2, mod: int = 4, most: int = 4096, size: int = 65536) -> Model:
    """Bound of the fit, not of the scoring: at most `most` labelled rows of each quality, and their whole texts."""
    rows = stored(labelled_sample(docs, labels, most, lambda i: remainder(i, mod) != held_out), "labelled")
    ids = [(r["doc_id"], r["quality"]) for r in rows.select("doc_id", "quality").collect()]
    nothing, kinds = np.zeros(0), {q for _, q in ids}
    if len(kinds) < 2:
        return Model(b"", b"", nothing, nothing, nothing, float(kinds.pop()) if kinds else 0.5)
    build, judge = builders(ids)

    def parts(it):
        for b in it:
            for i, q, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), bytes_of(b), strict=True):
                if i in build:
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([i], pa.int64()), "quality": pa.array([q], pa.int32()), "parts": pa.array([spread(t)], pa.list_(pa.binary()))})

    own = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "text")
    got = sorted(((r["quality"], r["doc_id"], r["parts"]) for r in own.mapInArrow(parts, "doc_id long, quality int, parts array<binary>").collect()), key=lambda r: r[:2])
    model = Model(*(build_dictionary([bytes(p) for k, _, own_parts in got if k == q for p in own_parts], size) for q in (1, 0)), nothing, nothing, nothing, 0.5)

    def measured(it):
        machines = model.machines()
        for b in it:
            x = [(i, q, model.measure(machines, t)) for i, q, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), bytes_of(b), strict=True) if i in judge]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([i for i, _, _ in x], pa.int64()), "quality": pa.array([q for _, q, _ in x], pa.int32()), "x": pa.array([m for _, _, m in x], pa.list_(pa.float64()))})

    held = sorted((r["doc_id"], r["quality"], r["x"]) for r in own.mapInArrow(measured, "doc_id long, quality int, x array<double>").collect())
    discard(rows)
    calibrate(model, np.array([x for _, _, x in held]), np.array([q for _, q, _ in held], float))
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, at_least: float = 0.7, held_out: int = 2, mod: int = 4, **how) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = train(docs, labels, held_out, mod, **how)

    def run(it):
        machines = model.machines() if len(model.weights) else []
        for b in it:
            x = np.array([model.measure(machines, t) for t in bytes_of(b)] if machines else np.zeros((b.num_rows, 3))).reshape(-1, 3)
            score = model.score(x)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "held_out": b.column(1), "score": pa.array(score), "predicted": pa.array((score >= at_least).astype(np.int32))})

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(F.col("doc_id"), mod) == held_out).alias("held_out"), "text")
    return own.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def passing(docs: DataFrame, labels: DataFrame, at_least: float = 0.7, known: DataFrame | None = None, **how) -> DataFrame:
    """The rows of docs whose score is high enough, with all their columns; no shuffle. known: the documents that the labels speak of, docs if not given."""
    model = train(docs if known is None else known, labels, **how)
    at = docs.columns.index("text")

    def kept(it):
        machines = model.machines() if len(model.weights) else []
        for b in it:
            x = np.array([model.measure(machines, (t.as_py() or "").encode()) for t in b.column(at)] if machines else np.zeros((b.num_rows, 3))).reshape(-1, 3)
            yield b.filter(pa.array(model.score(x) >= at_least))

    return docs.mapInArrow(kept, docs.schema)
