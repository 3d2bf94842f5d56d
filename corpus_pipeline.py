"""The corpus pipeline: documents to packed sequences, in five stages. Each stage's result is written and read again as the next one's documents."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.llm import packing, quality_model, quality_rules, simhash, substrings
from veilscan.llm.common import MADE, delete, discard, stored, table
from veilscan.llm.queries import pattern, tokenizer_file


#: Folders that the results of stages read while they are lazy.
_left: list[str] = []


def stage(fn: Callable[[SparkSession, DataFrame, str], DataFrame]):
    """A stage, which first deletes what results of earlier stages have read: these are written by now. What its own docs still read stays."""

    @functools.wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if old := [at for at in _left if at in MADE]:
            read = {f.rsplit("/", 2)[-2] for f in docs.inputFiles()}
            delete(spark, [at for at in old if at.rsplit("/", 1)[1] not in read])
        before = set(MADE)
        out = fn(spark, docs, sf_dir)
        _left[:] = [at for at in MADE if at in set(_left) or at not in before]
        return out

    return run_stage


@stage
def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.passing(docs, table(spark, sf_dir, "labels"))


@stage
def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under 0.7 go. It is fitted on the labelled rows of the whole table: few bad ones are left in docs."""
    return quality_model.passing(docs, table(spark, sf_dir, "labels"), at_least=0.7, known=table(spark, sf_dir, "documents"))


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, similarity 0.8): SimHash links first, then those beyond its limit, each verified."""
    return simhash.without_copies(docs, shingle=5, similarity=0.8)


@stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that an earlier document has are cut out."""
    out = substrings.remove_repeats(docs, least=50, rewrite=True)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, a row for each piece."""
    return packing.pack_texts(docs, packing.encode_with(tokenizer_file("byte_bpe_50k.tiktoken"), pattern(), end=1))


STAGES = [("quality_rules", rules), ("quality_classifier", classifier), ("simhash_near_dedup", near_dedup), ("suffix_array_dedup", substring_dedup), ("packing", pack)]

#: Forests, trained dictionaries and tokenizers are beyond SQL: tests compare its stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, fn in STAGES[:-1]:
        docs = stored(fn(spark, docs, sf_dir), name)
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
