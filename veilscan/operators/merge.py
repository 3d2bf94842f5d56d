"""From chunks to files: overlap duplicates, folds of chunk results, merged and finished file results, and content-hash deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import levels, rules

# States of a file in ascending order of severity; any other counts as rank 1.
STATUS_RANK = {"success": 0, "empty": 1, "parse_error": 2, "critical_error": 3}
MESSAGES = 100


def status_rank(status: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(v) for kv in STATUS_RANK.items() for v in kv])[status], F.lit(1))


def entity_keys(entities: DataFrame, width: int = 25) -> DataFrame:
    """Distinct (path, type, value, bucket): duplicates of an entity in overlapping chunks fall together. entities: path, type, value, start (in the file)."""
    return entities.select("path", "type", rules.entity_value(F.col("value")).alias("value"), rules.position_bucket(F.col("start"), width).alias("bucket")).distinct()


def fold_chunks(chunks: DataFrame) -> DataFrame:
    """One row for each path of chunk rows (path, chunk_id, text_length, score, confidence, strongest, reason, snippet, ms): of equal best scores the last chunk's
    texts stay; the snippet is the first that isn't empty."""
    best = F.max_by(F.struct("score", "confidence", "strongest", "reason"), F.struct("score", "chunk_id"))
    snippet = F.min_by("snippet", F.when(F.col("snippet") != "", F.col("chunk_id")))
    return chunks.groupBy("path").agg(F.count("*").alias("chunk_count"), F.sum("text_length").alias("text_length"), F.sum("ms").alias("ms"), best.alias("b"), F.coalesce(snippet, F.lit("")).alias("snippet")).select("path", "chunk_count", "text_length", "ms", F.col("b.score").alias("score"), F.col("b.confidence").alias("confidence"), F.col("b.strongest").alias("strongest"), F.col("b.reason").alias("reason"), "snippet")


def merge_partials(partials: DataFrame) -> DataFrame:
    """Partial results (path, ord, status, chunk_count, text_length, ms, score, confidence, strongest, reason, snippet, warnings) of a path in one row:
    the worst state, sums, of equal best scores the first one's texts, the first snippet, messages in order up to a bound."""
    first = F.struct(status_rank(F.col("status")).alias("rank"), (-F.col("ord")).alias("back"))
    best = F.max_by(F.struct("score", "confidence", "strongest", "reason"), F.struct("score", -F.col("ord")))
    notes = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.slice("warnings", 1, MESSAGES).alias("w")))), lambda x: x["w"]))
    out = partials.groupBy("path").agg(F.max_by("status", first).alias("status"), *(F.sum(c).alias(c) for c in ("chunk_count", "text_length", "ms")), best.alias("b"), F.coalesce(F.min_by("snippet", F.when(F.col("snippet") != "", F.col("ord"))), F.lit("")).alias("snippet"), F.slice(notes, 1, MESSAGES).alias("warnings"))
    return out.select("path", "status", "chunk_count", "text_length", "ms", *(F.col(f"b.{c}").alias(c) for c in ("score", "confidence", "strongest", "reason")), "snippet", "warnings")


def category_counts(keys: DataFrame) -> DataFrame:
    """(path, categories): how many distinct entities of each type."""
    n = keys.groupBy("path", "type").agg(F.count("*").alias("n"))
    return n.groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("categories"))


def finish(merged: DataFrame, keys: DataFrame) -> DataFrame:
    """File results: level and categories from the distinct entities; personal data if a category tells or the score is 20 or more; without chunks a success is empty."""
    none = F.create_map().cast("map<string,bigint>")
    out = merged.join(category_counts(keys), "path", "left").withColumn("categories", F.coalesce("categories", none))
    level = levels.protection_level(F.col("categories"))
    count = F.aggregate(F.map_values("categories"), F.lit(0).cast("long"), lambda a, v: a + v)
    status = F.when((F.col("chunk_count") == 0) & (F.col("status") == "success"), "empty").otherwise(F.col("status"))
    return out.withColumns({"protection_level": level, "entity_count": count, "has_pd": levels.has_sensitive(F.col("categories"), level) | (F.col("score") >= 20), "status": status, "protection_level_reason": levels.level_reason(level)})


def unseen(files: DataFrame, seen: DataFrame | None = None, order: str = "path") -> DataFrame:
    """Files whose file_hash was not seen before, one for each hash; a null hash is never a duplicate."""
    w = Window.partitionBy(F.coalesce("file_hash", F.concat(F.lit("path:"), F.col(order).cast("string")))).orderBy(order)
    out = files.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return out if seen is None else out.join(seen.select("file_hash").distinct(), "file_hash", "left_anti").select(out.columns)


def within_ttl(sightings: DataFrame, key: str, ts: str, seconds: int = 7 * 86400) -> DataFrame:
    """sightings with fresh: whether a key was seen for the first time in `seconds`, counted from its last fresh sighting (repeats don't prolong).

    The distinct times of a key are folded in order."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    times = sightings.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(at)).alias("t"))
    none = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<bigint>").alias("fresh")).cast("struct<last:bigint,fresh:array<bigint>>")

    def step(acc: Column, x: Column) -> Column:
        new = acc["last"].isNull() | (x >= acc["last"] + seconds * 1_000_000)
        return F.struct(F.when(new, x).otherwise(acc["last"]).alias("last"), F.when(new, F.concat(acc["fresh"], F.array(x))).otherwise(acc["fresh"]).alias("fresh")).cast("struct<last:bigint,fresh:array<bigint>>")

    fresh = times.select(F.col(key), F.aggregate("t", none, step)["fresh"].alias("_fresh"))
    out = sightings.join(fresh, key, "left")
    return out.withColumn("fresh", F.col(key).isNull() | F.array_contains("_fresh", at)).drop("_fresh")
