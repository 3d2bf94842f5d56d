"""Spark sessions for scans."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "veilscan", master: str | None = None, shared: str | None = None, **conf: str) -> SparkSession:
    """A session with what the plans of this library want: adaptive plans that split skewed joins, Arrow, and batches that bound what a Python worker holds. master: left to
    spark-submit if not given. shared: the folder that driver and executors share. conf: more settings, `_` for `.` in their names."""
    own = {
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.python.worker.reuse": "true",
        "spark.python.worker.faulthandler.enabled": "true", "spark.serializer": "org.apache.spark.serializer.KryoSerializer", "spark.sql.session.timeZone": "UTC",
    }
    if shared:
        own["spark.checkpoint.dir"] = shared
    builder = SparkSession.builder.appName(app).config(map=own | {k.replace("_", "."): v for k, v in conf.items()})
    return (builder.master(master) if master else builder).getOrCreate()
