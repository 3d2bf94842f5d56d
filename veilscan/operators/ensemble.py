"""The ensemble: pattern, tagger and rule entities of a document together, and what is said when the rules are off."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import levels, rules
from ..functions.text import looks_like_name
from . import detect as dt

#: A tagger: text -> (start, end, type) of its spans.
Tagger = Callable[[str], list[tuple[int, int, str]]]
TAGGED = ["PER", "ORG", "LOC", "DATE"]
# Warnings.
TOO_LONG, NO_MODELS = "Text too long for regex detection", "NLP models not available (install natasha)"


def tagger_entities(docs: DataFrame, tag: Tagger, text: str = "text", config: dt.Config = dt.Config()) -> DataFrame:
    """Entities of a tagger: doc_id, ord, type, value, confidence, start, end, context, source. Texts are cut to config.tagger_chars; a span has 0.65, a name-like
    person 0.15 more, an organization of over three characters 0.10 more; what stays under config.tagger_confidence is dropped. A failing tagger gives no spans."""
    most, window = config.tagger_chars, config.context

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            rows = []
            for d, t in zip(b["doc_id"], b["_t"], strict=True):
                t = (t or "")[:most]
                try:
                    spans = tag(t) if t else []
                except Exception:  # as an ensemble goes on without one of its detectors
                    spans = []
                rows += [(d, k, kind, t[a:z], a, z, t[max(0, a - window) : z + window].strip()) for k, (a, z, kind) in enumerate(spans) if kind in TAGGED]
            yield pd.DataFrame(rows, columns=["doc_id", "ord", "kind", "value", "start", "end", "context"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    own = docs.select("doc_id", F.col(text).alias("_t")).mapInPandas(run, f"doc_id {id_type}, ord int, kind string, value string, start int, end int, context string")
    more = F.when((F.col("kind") == "PER") & looks_like_name(F.col("value")), 0.15).when((F.col("kind") == "ORG") & (F.length("value") > 3), 0.10).otherwise(0.0)
    sure = F.round(F.lit(0.65) + more, 2)
    return own.withColumn("confidence", sure).where(F.col("confidence") >= config.tagger_confidence).select("doc_id", "ord", rules.entity_alias(F.col("kind")).alias("type"), "value", "confidence", "start", "end", "context", F.lit("nlp").alias("source"))


def fallback_assessment(entities: DataFrame) -> DataFrame:
    """Assessment from entities alone, for when the rules are off: any entity is a medium finding of score 40; the strongest category is the first entity's."""
    order = F.create_map(*[F.lit(v) for kv in dt.SOURCES.items() for v in kv])[F.col("source")]
    per = entities.groupBy("doc_id").agg(F.array_sort(F.collect_set("type")).alias("detected_categories"), F.min_by("type", F.struct(order, "ord")).alias("strongest_category"), F.count("*").alias("hit_count"))
    return per.select("doc_id", F.lit(True).alias("has_personal_data"), F.lit("medium").alias("overall_confidence"), F.lit(40).alias("overall_risk_score"), "detected_categories", "strongest_category", F.lit("Найдены подтвержденные сущности").alias("short_reason"), "hit_count")


def detect_all(docs: DataFrame, text: str = "text", config: dt.Config = dt.Config(), tag: Tagger | None = None) -> DataFrame:
    """One row for every document: doc_id, categories over the merged entities of all enabled detectors, protection_level, entity_count, score, confidence,
    has_personal_data, warnings. Masks (rules) and raw values (patterns) of one finding count as two. Without text a result is blank, its level null."""
    parts, warnings = [], F.array().cast("array<string>")
    hits = dt.whole_text_entities(docs, text, config) if config.whole_text else None
    if hits is not None:
        parts.append(hits)
    gate = None
    if config.tagger:
        gate = dt.run_tagger(docs, hits, text, config)
        parts.append(tagger_entities(docs.join(gate.where("run"), "doc_id", "left_semi"), tag or (lambda t: []), text, config))
    found = dt.candidates(docs, text) if config.rules else None
    conf = dt.confirmed(dt.evidence(found), config.mediums) if config.rules else None
    if conf is not None:
        parts.append(dt.rule_entities(conf))
    entities = dt.merge_entities(*parts)
    n = entities.groupBy("doc_id", "type").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("categories"), F.sum("n").alias("entity_count"))
    said = (dt.assess(conf) if conf is not None else fallback_assessment(entities)).select("doc_id", "has_personal_data", "overall_risk_score", "overall_confidence")
    size = F.coalesce(F.length(text), F.lit(0))
    out = docs.select("doc_id", size.alias("_size")).join(n, "doc_id", "left").join(said, "doc_id", "left")
    blank, none = F.col("_size") == 0, F.array().cast("array<string>")
    if hits is not None:
        warnings = F.when(F.col("_size") > 1_000_000, F.array(F.lit(TOO_LONG))).otherwise(none)
    if gate is not None:
        out = out.join(gate, "doc_id", "left")
        ran = F.array(F.lit(NO_MODELS)) if tag is None else F.when(F.col("_size") > config.tagger_chars, F.array(F.lit(f"Text truncated to {config.tagger_chars} chars for NLP"))).otherwise(none)
        warnings = F.concat(warnings, F.when(F.coalesce("run", F.lit(False)), ran).otherwise(F.array(F.lit("nlp skipped by suspicious prefilter"))))
    warnings = F.when(blank, none).otherwise(warnings)
    categories = F.coalesce("categories", F.create_map().cast("map<string,bigint>"))
    level = F.when(~blank, levels.protection_level(categories))
    return out.select("doc_id", categories.alias("categories"), level.alias("protection_level"), F.coalesce("entity_count", F.lit(0)).alias("entity_count"), F.coalesce("has_personal_data", F.lit(False)).alias("has_personal_data"), F.coalesce("overall_risk_score", F.lit(0)).alias("overall_risk_score"), F.coalesce("overall_confidence", F.lit("no_pd_or_weak")).alias("overall_confidence"), warnings.alias("warnings"))


def detect_personal_data(spark: SparkSession, text: str, config: dt.Config = dt.Config(), use_ensemble: bool = True, tag: Tagger | None = None) -> dict:
    """The finding for one text, as a dictionary with at most config.entities entities. use_ensemble: all detectors that config enables, else the rules alone."""
    began = time.perf_counter()
    doc = spark.createDataFrame([(0, text or "")], "doc_id long, text string")
    said = dt.detect(doc, config=config).first().asDict(recursive=True)
    out = {k: said[k] for k in ("has_personal_data", "overall_confidence", "overall_risk_score", "detected_categories", "strongest_category", "short_reason", "protection_level", "categories", "entities", "hit_count")}
    out |= {"legal_buckets_present": ["ordinary"] if said["hit_count"] else [], "long_reason": said.get("long_reason") or said["short_reason"], "entity_count": said["hit_count"], "warnings": []}
    if use_ensemble:
        whole = detect_all(doc, config=config, tag=tag).first().asDict(recursive=True)
        out |= {k: whole[k] for k in ("categories", "protection_level", "entity_count", "warnings")}
    level = out["protection_level"]
    out["protection_level_reason"] = spark.range(1).select(levels.level_reason(F.lit(level))).first()[0] if level else None
    return out | {"detected": out["has_personal_data"], "processing_time_ms": round((time.perf_counter() - began) * 1000, 2)}
