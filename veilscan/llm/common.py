"""Helpers that several operators share: the shared folder, batches, sampling, connected components."""

from __future__ import annotations

import ctypes
import itertools
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_SPACE = b" \t\n\r\x0b\x0c"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); one of this machine only where that is unset and all of Spark runs here, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file:/tmp/checkpoints/veilscan"
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(at)
    return at


#: Folders that stored() has made in this process.
MADE: list[str] = []


def stored(df: DataFrame, name: str = "part") -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    MADE.append(at)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def delete(spark: SparkSession, folders: list[str]) -> None:
    """Deletes folders that stored() has made."""
    for at in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
        MADE.remove(at)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of stored() tables that nothing reads any more. Files elsewhere stay."""
    for df in tables:
        names = {f.rsplit("/", 2)[1] for f in df.inputFiles()}
        delete(df.sparkSession, [at for at in MADE if at.rsplit("/", 1)[1] in names])


def trim() -> None:
    """Gives what a task has freed back to the system, as the worker lives on."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def batches(fn, schema: pa.Schema):
    """A mapInArrow function: fn(batch) -> dict of columns, one batch out for one in."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_pydict(fn(b), schema=schema)
        trim()

    return run


def texts_of(b: pa.RecordBatch, name: str = "text") -> Iterator[str]:
    """The texts one at a time (null: empty), so that one Python string is alive at once."""
    for x in b.column(b.schema.get_field_index(name)):
        yield x.as_py() or ""


def bytes_of(b: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    """The texts' UTF-8 bytes, without decoding (null: empty)."""
    col = b.column(b.schema.get_field_index(name))
    col = col.cast(pa.binary()) if not pa.types.is_binary(col.type) else col
    for x in col:
        yield x.as_py() or b""


def remainder(doc_id, mod: int):
    """crc32 of the id as text, modulo mod; a null id gives 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(mod)), F.lit(0))


def labelled(labels: DataFrame, keep=None) -> DataFrame:
    """doc_id, quality (0 or 1), each id once. keep: a condition on doc_id. An id labelled twice with different values is left out."""
    own = labels.select("doc_id", "quality").where("doc_id is not null and quality in (0, 1)")
    own = own.where(keep(F.col("doc_id"))) if keep is not None else own
    return own.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most")).where("quality = _most").drop("_most")


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int, keep=None) -> DataFrame:
    """At most `most` labelled documents of each quality (doc_id, text, quality), those whose ids have the smallest hashes.

    Only ids and labels are ordered; the bounded list of ids is then joined to the texts. keep: a condition on doc_id.
    An id labelled twice with different values is left out; of rows of one id the one of the smallest hash counts, so the bound holds whatever repeats."""
    own = labelled(labels, keep)
    parts = [own.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for q in (0, 1)]
    ids = parts[0].unionByName(parts[1])
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most 2 * most rows of two numbers
    return rows.groupBy("doc_id", "quality").agg(F.min_by(F.coalesce("text", F.lit("")), F.struct(F.xxhash64("text"), F.md5("text"))).alias("text")).select("doc_id", "text", F.col("quality").cast("int").alias("quality"))


# ---------------------------------------------------------------- connected components


def label_by_min(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest reachable index of each of n items, by edges a-b; label: an earlier result to go on from."""
    label = np.arange(n) if label is None else label
    while len(a):
        la, lb = label[a], label[b]
        live = la != lb
        if not live.any():
            break
        a, b, la, lb = a[live], b[live], la[live], lb[live]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        np.minimum.at(label, high, low)
        while True:
            nxt = label[label]
            if (nxt == label).all():
                break
            label = nxt
    return label


def contract(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of a partition to at most one for each node: (node, smallest node reachable in this partition)."""
    got = list(it)
    if not got:
        return
    t = pa.Table.from_batches(got)
    a, b = t.column("a").to_numpy(), t.column("b").to_numpy()
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = label_by_min(len(nodes), inv[: len(a)], inv[len(a) :])
    own = np.nonzero(label != np.arange(len(nodes)))[0]
    yield pa.RecordBatch.from_pydict({"a": nodes[own], "b": nodes[label[own]]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a long, b long): the smallest node reachable.

    Rounds of hooking to the smallest neighbouring label and pointer jumping; all groupings combine before they shuffle, and each
    round is written to the shared folder. The number of rounds grows with the logarithm of the longest path."""
    e = edges.select("a", "b").where("a <> b").mapInArrow(contract, "a long, b long")
    e = stored(e.distinct(), "edges")
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")).withColumnRenamed("a", "node"), "label")
    for _ in itertools.count():
        # an edge brings the label of one end to the other end, and to the label of that end
        la, lb = label.select(F.col("node").alias("a"), F.col("root").alias("ra")), label.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        across = e.join(la, "a").join(lb, "b").where("ra <> rb").select(F.greatest("ra", "rb").alias("node"), F.least("ra", "rb").alias("root"))
        hooked = label.union(across).groupBy("node").agg(F.min("root").alias("root"))
        up = hooked.select(F.col("node").alias("root"), F.col("root").alias("up"))
        nxt = stored(hooked.join(up, "root").select("node", F.col("up").alias("root")), "label")
        moved = nxt.join(label.withColumnRenamed("root", "was"), "node").where("root <> was").limit(1).count()
        discard(label)
        label = nxt
        if not moved:
            discard(e)
            return label
