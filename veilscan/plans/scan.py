"""The scan of a folder: walk, drop known contents, parse, cut into chunks, detect, merge by file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import chunks, stream_chunks
from ..operators.detect import Config, detect
from ..operators.merge import MESSAGES, entity_keys, finish, fold_chunks, unseen
from ..sources.files import STREAMED, binary_files, parse, walk


def chunk_results(texts: DataFrame, size: int = 12_000, overlap: int = 500, config: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """Chunk rows for fold_chunks, and the entities with their places in the file. texts: path, text; column cut (if there): "stream", as a text stream is cut; "whole", one chunk;
    "pages", each of the column pages for itself; else in windows."""
    text, pages = F.col("text"), None
    cut = chunks(text, size, overlap)
    if "cut" in texts.columns:
        cut = F.when(F.col("cut") == "stream", stream_chunks(text, size, overlap)).when(F.col("cut") == "whole", chunks(text, 2**31 - 1, 0)).otherwise(cut)
        if "pages" in texts.columns:
            pages = texts.where("cut = 'pages'").select("path", F.posexplode("pages").alias("page", "text")).withColumn("page", F.col("page") + 1)
            blank = texts.where(~(F.coalesce("cut", F.lit("")) == "pages") | ~F.exists("pages", lambda p: F.trim(p) != ""))  # pages without any text are one empty chunk
            texts = blank.withColumn("text", F.when(F.col("cut") == "pages", "").otherwise(text))
    rows = texts.select("path", F.explode(cut).alias("c")).select("path", F.col("c.chunk_id").cast("long").alias("chunk_id"), F.col("c.text").alias("text"), F.col("c.start").cast("long").alias("offset"))
    if pages is not None:
        rows = rows.unionByName(page_chunks(pages, size, overlap).select("path", "chunk_id", "text", F.col("chunk_start").cast("long").alias("offset")))
    rows = rows.withColumn("doc_id", F.struct("path", "chunk_id", "offset"))
    found = detect(rows, config=config).select("doc_id.*", "overall_risk_score", "overall_confidence", "strongest_category", "short_reason", "entities")
    heads = rows.select("path", "chunk_id", F.length("text").cast("long").alias("text_length"), F.when(F.trim("text") != "", F.left("text", F.lit(300))).otherwise("").alias("snippet"))
    folded = heads.join(found.select("path", "chunk_id", F.col("overall_risk_score").alias("score"), F.col("overall_confidence").alias("confidence"), F.col("strongest_category").alias("strongest"), F.col("short_reason").alias("reason"), F.lit(0.0).alias("ms")), ["path", "chunk_id"])
    entities = found.select("path", "offset", F.explode("entities").alias("e")).select("path", F.col("e.type").alias("type"), F.col("e.masked").alias("value"), (F.col("offset") + F.col("e.start")).alias("start"))
    return folded, entities


def scan_texts(texts: DataFrame, size: int = 12_000, overlap: int = 500, config: Config = Config()) -> DataFrame:
    """File results for texts (path, status, text; if there also cut and pages, see chunk_results, and warnings, errors and ms of the reading, which come through)."""
    rows, entities = chunk_results(texts.where("status = 'success'"), size, overlap, config)
    folded = fold_chunks(rows).drop("ms")
    none = F.array().cast("array<string>")
    said = {c: F.slice(F.coalesce(c, none), 1, most) if c in texts.columns else none for c, most in (("warnings", 3), ("errors", MESSAGES))}
    ms = F.coalesce("ms", F.lit(0.0)) if "ms" in texts.columns else F.lit(0.0)
    out = texts.select("path", "status", ms.alias("ms"), *(v.alias(c) for c, v in said.items())).join(folded, "path", "left")
    filled = out.withColumns({"chunk_count": F.coalesce("chunk_count", F.lit(0)), "text_length": F.coalesce("text_length", F.lit(0)), "score": F.coalesce("score", F.lit(0)), "snippet": F.coalesce("snippet", F.lit(""))})
    return finish(filled, entity_keys(entities))


def scan_folder(spark: SparkSession, root: str, seen: DataFrame | None = None, readers: dict[str, Callable[[bytes], str | list[str]]] | None = None, store: bool | None = None, **how) -> DataFrame:
    """File results for a folder. seen: file_hash of contents known before. readers: see parse(). store: list and read by Spark, as any folder must be that not every machine
    can open; by default where root is the address of one."""
    store = "://" in root and not root.startswith("file://") if store is None else store
    files = unseen(binary_files(spark, root) if store else walk(spark, root, with_hash=True), seen)
    texts = parse(files, readers)
    cut = F.when(F.col("extension").isin(*STREAMED), "stream").when(F.col("pages").isNotNull(), "pages").otherwise("whole")
    return scan_texts(texts.withColumn("cut", cut), **how)


def mask_text(text, pattern_names: list[str] = ("card", "snils", "email", "phone")):
    """A text column with all matches of the patterns replaced by their type in brackets."""
    for name in pattern_names:
        text = F.regexp_replace(text, f"(?U){rules.PATTERNS[name]}", f"[{name}]")
    return text


def page_chunks(pages, size: int = 12_000, overlap: int = 500):
    """Chunks of paged files (path, page, text): blank pages are left out, each page is cut for itself, offsets go on across pages, the last chunk of a file is marked."""
    from pyspark.sql.window import Window

    said = pages.where(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("text", F.concat(F.lit("[Страница "), F.col("page").cast("string"), F.lit("]\n"), F.trim("text")))
    file = Window.partitionBy("path").orderBy("page")
    based = said.withColumn("base", F.coalesce(F.sum(F.length("text")).over(file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = based.select("path", "page", "base", F.posexplode(chunks(F.col("text"), size, overlap)).alias("k", "c"))
    order = Window.partitionBy("path").orderBy("page", "k")
    return rows.select("path", "page", (F.row_number().over(order) - 1).cast("long").alias("chunk_id"), (F.col("base") + F.col("c.start")).alias("chunk_start"), (F.col("base") + F.col("c.end")).alias("chunk_end"), F.col("c.text").alias("text"), F.lead("k").over(order).isNull().alias("is_last"))


def upload_checks(uploads, suffixes: list[str], most_bytes: int):
    """uploads (path, size_bytes) with problem: unsupported suffix, empty or too large, in that order; null if it is accepted."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return uploads.withColumn("problem", F.when(~ext.isin(suffixes), "unsupported").when(F.col("size_bytes") == 0, "empty").when(F.col("size_bytes") > most_bytes, "too large"))
