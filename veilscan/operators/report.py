"""Reports: the CSV projection, JSON, counts for an evaluation, job statistics, health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import file_format

# Header of the CSV report.
HEADER = ["путь", "категории_пДн", "количество_находок", "УЗ", "формат_файла", "причина"]


def report_rows(results: DataFrame, findings_only: bool = True) -> DataFrame:
    """The six text columns of the report. results: path, has_pd, categories (map of counts), protection_level, reason."""
    own = results.where("has_pd") if findings_only else results
    names = F.array_sort(F.map_keys("categories"))
    counts = F.array_join(F.transform(names, lambda k: F.concat_ws("=", k, F.col("categories")[k].cast("string"))), "; ")
    cols = [F.col("path"), F.array_join(names, ", "), F.when(F.size(names) == 0, "0").otherwise(counts), F.coalesce("protection_level", F.lit("УЗ-4")), file_format(F.col("path")), F.coalesce("reason", F.lit(""))]
    return own.select(*(c.alias(h) for c, h in zip(cols, HEADER, strict=True)))


def write_csv(results: DataFrame, path: str, findings_only: bool = True) -> None:
    report_rows(results, findings_only).write.option("header", True).mode("overwrite").csv(path)


def write_json(results: DataFrame, path: str, findings_only: bool = True) -> None:
    (results.where("has_pd") if findings_only else results).write.mode("overwrite").json(path)


def by_category(results: DataFrame) -> DataFrame:
    """Files with each category, and entities of it."""
    return results.where("has_pd").select(F.explode("categories").alias("category", "n")).groupBy("category").agg(F.count("*").alias("files"), F.sum("n").alias("entities"))


def by_format(results: DataFrame) -> DataFrame:
    return results.groupBy(file_format(F.col("path")).alias("format")).agg(F.count("*").alias("files"), F.count_if("has_pd").alias("flagged"))


def top_reasons(results: DataFrame, n: int = 10) -> DataFrame:
    """The most frequent reasons (empty: n/a), ties by the smallest path."""
    reason = F.when(F.coalesce("reason", F.lit("")) == "", "n/a").otherwise(F.col("reason"))
    return results.groupBy(reason.alias("reason")).agg(F.count("*").alias("files"), F.min("path").alias("_first")).orderBy(F.desc("files"), "_first").limit(n).drop("_first")


def job_stats(results: DataFrame) -> DataFrame:
    """One row: files by state (skipped ones together), files with findings, entities, mean ms of files with findings."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    return results.agg(
        F.count("*").alias("total"), is_("success").alias("success"), is_("empty").alias("empty"), is_("parse_error").alias("parse_error"), is_("critical_error").alias("critical_error"),
        F.count_if(F.col("status").startswith("skipped")).alias("skipped"), F.count_if("has_pd").alias("pd_found"), F.coalesce(F.sum("entity_count"), F.lit(0)).alias("entities"),
        (F.coalesce(F.sum(F.when(F.col("has_pd"), F.col("ms"))), F.lit(0.0)) / F.greatest(F.lit(1), F.count_if("has_pd"))).alias("avg_pd_ms"),
    )


def health(services: DataFrame) -> DataFrame:
    """One state for rows (name, status): an error outweighs degraded, that outweighs the rest."""
    rank = F.max(F.when(F.col("status") == "error", 2).when(F.col("status") == "degraded", 1).otherwise(0))
    return services.agg(F.element_at(F.array(F.lit("ok"), F.lit("degraded"), F.lit("error")), (F.coalesce(rank, F.lit(0)) + 1).cast("int")).alias("status"), F.count("*").alias("services"))


def ocr_summary(words: DataFrame, key: str, least: float = 0.0) -> DataFrame:
    """Text and mean confidence of OCR words (key, ord, word, confidence): blank words, a confidence of -1 or under `least` are left out."""
    own = words.where((F.trim("word") != "") & (F.col("confidence") != -1) & (F.col("confidence") >= least))
    return own.groupBy(key).agg(F.avg("confidence").alias("mean_confidence"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "word"))), lambda x: x["word"]), " ").alias("text"), F.count("*").alias("words"))


def low_confidence(pages: DataFrame, least: float = 60.0) -> DataFrame:
    """pages (mean_confidence, ...) with low_confidence; the text stays as it is."""
    return pages.withColumn("low_confidence", F.coalesce(F.col("mean_confidence") < least, F.lit(True)))


def skew_angle(angles: DataFrame, key: str) -> DataFrame:
    """Median angle of the lines of each page whose angle lies between -45 and 45 degrees; 0 without such lines."""
    own = F.when((F.col("angle") > -45) & (F.col("angle") < 45), F.col("angle"))
    return angles.groupBy(key).agg(F.coalesce(F.median(own), F.lit(0.0)).alias("skew"))
