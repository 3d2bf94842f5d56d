"""Stored tables and what becomes of their files."""

import os

import corpus_pipeline
from pyspark.sql import functions as F

from veilscan.llm import common


def _there(spark, df):
    return all(os.path.exists(f.replace("file://", "").replace("file:", "")) for f in df.inputFiles())


def test_discard_takes_only_its_table(spark, tmp_path):
    a, b = (common.stored(spark.range(9).withColumn("x", F.lit(k)), "same") for k in "ab")
    spark.range(3).write.parquet(f"{tmp_path}/own")
    own, files = spark.read.parquet(f"{tmp_path}/own"), [f.replace("file://", "") for f in a.inputFiles()]
    common.discard(a, own)
    assert not any(map(os.path.exists, files)) and b.count() == 9 and own.count() == 3


def test_a_later_stage_clears_what_earlier_ones_left(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    out = stages["simhash_near_dedup"](spark, docs, sf)
    left = [at for at in common.MADE if at.rsplit("/", 1)[1].startswith("prints-")]
    assert left and out.count() > 0
    # its result still reads them: they stay while it is what the next stage is given
    assert stages["suffix_array_dedup"](spark, out, sf).count() == out.count()
    written = common.stored(out, "written")
    stages["suffix_array_dedup"](spark, written, sf)
    assert not set(left) & set(common.MADE) and written.count() > 0
