"""The pipeline's classifier learns from labelled rows that the stage before has taken away."""

from pyspark.sql import functions as F

from veilscan.llm.common import table


def test_bad_rows_gone_before(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    bad = docs.join(labels.where("quality = 0").select("doc_id"), "doc_id", "left_semi").select(docs.columns)
    good = docs.join(labels.where("quality = 1").select("doc_id"), "doc_id", "left_semi").select(docs.columns)
    unlabelled = bad.withColumn("doc_id", F.col("doc_id") + 10_000_000)  # no labelled bad row is left
    out = cp.classifier(spark, good.union(unlabelled), sf)
    assert bad.count() > 10 and good.count() > 10
    assert out.where("doc_id >= 10000000").count() <= 0.2 * bad.count()
    assert out.where("doc_id < 10000000").count() >= 0.9 * good.count()
