"""The corpus and its queries on keys beyond those of the small tables, and what plans do once and in several tasks."""

import duckdb
import pytest
from pyspark.sql import functions as F

from veilscan import queries as core
from veilscan.functions.text import guess_language
from veilscan.operators import detect as dt
from veilscan.sources.corpus import corpus

from .test_sql import canonical


@pytest.fixture(scope="module")
def keys(spark, tmp_path_factory):
    """A folder with customers of the keys 12,625 to 12,680 (whose numbers go from 1... to 2...), of 618,769 (a small number with remainder 100) and of some large keys, in one file."""
    at = tmp_path_factory.mktemp("keys")
    own = [*range(12_625, 12_681), 618_769, *range(899_950, 900_000)]
    spark.createDataFrame([(k,) for k in own], "c_custkey long").coalesce(1).write.parquet(f"{at}/customer.parquet")
    return str(at)


def same_as_sql(spark, at, name):
    con = duckdb.connect()
    con.execute(f"create view customer as select * from read_parquet('{at}/customer.parquet/*.parquet')")
    got, want = core.queries()[name](spark, at).toPandas(), con.execute(core.oracle_sql()[name]).df()
    assert canonical(got) == canonical(want)


def test_corpus_text_of_a_small_number(spark, keys):
    same_as_sql(spark, keys, "corpus_text")
    assert [r["text"] for r in core.queries()["corpus_text"](spark, keys).where("doc_id = 618769").collect()] == ["СНИЛС: 000-031-713 01"]


def test_every_tax_number_is_spoilt(spark, keys):
    same_as_sql(spark, keys, "rejected_by_checks")


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_items_of_a_line_are_made_once(spark):
    docs = spark.createDataFrame([(1, "ИНН: 500100732259")], "doc_id long, text string")
    assert optimized(dt.candidates(docs)).count("placeholder_template") == 1


def test_letters_are_counted_once(spark):
    df = spark.createDataFrame([("abc где",), ("где",), ("12",), (None,)], "t string")
    plan = optimized(df.select(guess_language(F.col("t")).alias("guess")))
    assert plan.count("regexp_replace") == 2
    assert [r[0] for r in df.select(guess_language(F.col("t"))).collect()] == ["mixed", "rus", None, None]


def test_keys_of_one_file_are_dealt_over_tasks(spark, keys):
    c = corpus(spark.read.parquet(f"{keys}/customer.parquet"))
    assert c.rdd.getNumPartitions() == 4  # as many as the session shuffles into


def test_no_side_that_grows_is_broadcast(spark, keys):
    for name in ("job_stats", "detect_corpus"):
        assert "Broadcast" not in core.queries()[name](spark, keys)._jdf.queryExecution().executedPlan().toString()


def test_findings_of_documents_without_an_id(spark, tmp_path):
    rows = [(None, "карта 4111 1111 1111 1111"), (None, "нет"), (1, None), (2, "карта 4111 1111 1111 1111"), (2, "карта 4111 1111 1111 1111")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got, want = core.queries()["card_findings"](spark, str(tmp_path)).collect(), con.execute(core.oracle_sql()["card_findings"]).fetchall()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and len(got) == 2
    assert dt.detect(spark.read.parquet(f"{tmp_path}/documents.parquet")).count() == 3
