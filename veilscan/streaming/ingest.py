"""Streams: file events in, deduplicated, detected, out. A file stream stands in where no broker's connector is installed; the Kafka form has the same columns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.detect import detect

MESSAGE = "path string, size_bytes long, extension string, file_hash string, text string, ts timestamp"


def from_files(spark: SparkSession, folder: str) -> DataFrame:
    """Messages as JSON lines of a folder."""
    return spark.readStream.schema(MESSAGE).json(folder)


def from_kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Messages of a topic, from its beginning."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load()
    return raw.select(F.from_json(F.col("value").cast("string"), MESSAGE).alias("m")).select("m.*")


def valid(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages with path and extension, and the others."""
    ok = F.col("path").isNotNull() & F.col("extension").isNotNull()
    return messages.where(ok), messages.where(~ok)


def first_seen(messages: DataFrame, period: str = "7 days") -> DataFrame:
    """One message for each file_hash in the period; the state is dropped by the watermark. Messages without a hash all pass, keyed by their path."""
    keyed = messages.withWatermark("ts", period).withColumn("_key", F.coalesce("file_hash", F.concat(F.lit("path:"), F.col("path"))))
    return keyed.dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def first_in_ttl(messages: DataFrame, seconds: int = 7 * 86400, delay: str = "1 hour") -> DataFrame:
    """The messages of each file_hash that come `seconds` or more after its last message that passed, by their times; repeats don't prolong. Messages without a hash all pass.

    A key's state is one time, dropped as soon as the watermark has passed its end. Messages later than `delay` may be lost, as with any watermark."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values(["ts", "path"], kind="stable")
        if rows["file_hash"].iloc[0] is None:
            yield rows[names]
            return
        last, keep = state.get[0] if state.exists else None, []
        for at in (rows["ts"].astype("datetime64[us]").astype("int64")).tolist():
            keep.append(last is None or at >= last + seconds * 1_000_000)
            last = at if keep[-1] else last
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield rows[keep][names]

    names = messages.columns
    keyed = messages.withWatermark("ts", delay).withColumn("_key", F.coalesce("file_hash", F.concat(F.lit("path:"), F.col("path"))))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in messages.schema)
    return keyed.groupBy("_key").applyInPandasWithState(run, schema, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def file_message(files: DataFrame) -> DataFrame:
    """key, value for a topic of found files: hash or path, and JSON of path, size_bytes, extension, file_hash."""
    return files.select(F.coalesce("file_hash", "path").alias("key"), F.to_json(F.struct("path", "size_bytes", "extension", "file_hash")).alias("value"))


def result_message(results: DataFrame) -> DataFrame:
    """key, value for a results topic: hash or path, and JSON with the text cut to 10,000 characters."""
    body = F.to_json(F.struct("path", "file_hash", F.left("text", F.lit(10_000)).alias("extracted_text"), (F.length("text") > 10_000).alias("text_truncated"), "has_personal_data", "overall_risk_score", "protection_level"))
    return results.select(F.coalesce("file_hash", "path").alias("key"), body.alias("value"))


def detect_stream(messages: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Writes results of new files to Parquet, micro-batch by micro-batch, exactly once by the checkpoint. Empty texts are not passed on."""

    def batch(rows: DataFrame, number: int) -> None:
        own = rows.where(F.trim("text") != "").withColumn("doc_id", F.coalesce("file_hash", "path"))
        found = own.join(detect(own).select("doc_id", "has_personal_data", "overall_risk_score", "protection_level", "hit_count"), "doc_id")
        found.drop("doc_id").write.mode("overwrite").parquet(f"{out}/batch={number}")  # a batch that runs again replaces itself

    writer = first_seen(valid(messages)[0]).writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
