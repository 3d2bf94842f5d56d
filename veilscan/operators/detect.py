"""Detection of personal data: lines, evidence, confirmation, assessment, level.

Evidence is found by expressions over the lines of a text; only lines with evidence or exclusions leave the scan, and only these few
rows are grouped by document. Every function takes and returns DataFrames; doc_id names the documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import levels, rules
from ..functions.text import contains_any, digits, lines, matches, normalize, snippet, structured


@dataclass(frozen=True)
class Config:
    rules: bool = True
    whole_text: bool = False
    tagger: bool = False
    context: int = 80
    mediums: int = 2
    least_confidence: float = 0.75
    tagger_confidence: float = 0.7
    tagger_always: bool = False
    tagger_hits: int = 1
    tagger_words: tuple = ("фио", "дата рождения", "паспорт", "снилс", "инн", "адрес", "тел", "email")
    tagger_chars: int = 50_000
    entities: int = 100


ITEM = "struct<type:string,subtype:string,value:string,strength:string,confidence:double,start:int,end:int,reasons:array<string>,rejected:string>"


#: What every candidate, context word of an address or placeholder word has at least: a digit, an @, a Cyrillic letter, a < or one of these words.
MAY_HOLD = "[0-9@<\\u0400-\\u04ff]|(?i:" + "|".join(w for w in rules.PLACEHOLDERS if w.isascii()) + ")|(?U)\\d"


def scopes(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, idx, line, offset of the non-blank lines of the normal form."""
    return docs.select("doc_id", F.explode(lines(normalize(F.col(text)))).alias("s")).select("doc_id", "s.idx", F.col("s.text").alias("line"), "s.offset")


def _found(line: Column, pattern: str, kind: str, subtype: str, strength: str, confidence: float, reasons: list[str], rejected, value=lambda v: v) -> Column:
    """Items for all matches of a pattern; rejected(value, match) gives a reason or null."""

    def item(m: Column) -> Column:
        v = value(m["value"])
        return F.struct(F.lit(kind).alias("type"), F.lit(subtype).alias("subtype"), v.alias("value"), F.lit(strength).alias("strength"), F.lit(confidence).alias("confidence"), m["start"].alias("start"), m["end"].alias("end"), F.array(*map(F.lit, reasons)).alias("reasons"), rejected(v).cast("string").alias("rejected")).cast(ITEM)

    return F.transform(matches(line, pattern), item)


def items(line: Column, low: Column) -> Column:
    """array of items of a line, also given in lower case, in the order of the rules; a placeholder word rejects the line as a whole."""
    near = lambda words: contains_any(low, words)
    person, field = near(rules.PERSON), structured(line)
    p = rules.PATTERNS
    no = F.lit(None).cast("string")
    loose = near(rules.PERSON) | field
    single = lambda kind, subtype, value, strength, confidence, start, end, reasons, rejected: F.struct(F.lit(kind).alias("type"), F.lit(subtype).alias("subtype"), value.alias("value"), F.lit(strength).alias("strength"), F.lit(confidence).alias("confidence"), start.alias("start"), end.alias("end"), F.array(*map(F.lit, reasons)).alias("reasons"), rejected.cast("string").alias("rejected")).cast(ITEM)
    none = F.array().cast(f"array<{ITEM}>")
    account_ok = line.rlike(f"(?U){p['bik']}") & near(rules.ACCOUNT)
    accounts = _found(line, p["account"], "bank_account", "account_bik_pair", "STRONG", 0.91, ["context:bik_nearby"], lambda v: no)
    lone = F.array(single("bank_account", "account_bik_pair", F.lit(""), "STRONG", 0.91, F.lit(0), F.lit(0), [], F.lit("account_without_bik")))
    groups = [
        _found(line, p["snils"], "snils", "snils", "STRONG", 0.97, ["validator:snils_checksum", "context:snils_keyword"], lambda v: F.when(~rules.snils_valid(digits(v)), "snils_checksum_fail").when(~near(rules.SNILS), "snils_without_context")),
        _found(line, p["inn"], "inn", "inn", "STRONG", 0.95, ["validator:inn_checksum", "context:inn_or_field"], lambda v: F.when(~rules.inn_valid(v), "inn_checksum_fail").when(~near(rules.INN) & ~field, "inn_without_context")),
        _found(line, p["card"], "payment_card_number", "bank_card", "STRONG", 0.96, ["validator:luhn"], lambda v: F.when(~F.length(v).between(16, 19), "card_length_fail").when(~F.call_function("luhn_check", v), "card_luhn_fail"), digits),
        _found(line, p["mrz"], "mrz", "mrz", "STRONG", 0.93, ["validator:mrz_shape"], lambda v: F.when(F.length(F.regexp_replace(v, "[^<]", "")) < 5, "mrz_shape_fail")),
        _found(line, p["passport"], "passport", "passport_rf", "STRONG", 0.92, ["context:passport_keywords"], lambda v: F.when(~near(rules.PASSPORT), "passport_without_context")),
        F.when(F.size(accounts) == 0, none).when(account_ok, accounts).otherwise(lone),
        _found(line, p["email"], "email", "email", "MEDIUM", 0.72, ["context:person_or_structured"], lambda v: F.when(F.substring_index(v, "@", 1).isin(rules.MAILBOXES) & ~person, "generic_email").when(~loose, "email_without_person_context"), F.lower),
        _found(line, p["phone"], "phone", "phone_ru", "MEDIUM", 0.70, ["context:person_or_structured"], lambda v: F.when(~loose, "phone_without_person_context"), rules.phone_normal),
        _found(line, p["dob"], "date_of_birth", "date_of_birth", "MEDIUM", 0.68, ["context:dob_keyword", "validator:age_range"], lambda v: F.when(~near(rules.BIRTH), "date_without_dob_context").when(~rules.birth_plausible(v), "dob_age_implausible")),
        _found(line, p["fio"], "person_name", "fio", "WEAK", 0.45, ["pattern:fio"], lambda v: F.when(contains_any(F.lower(v), rules.ORGANIZATION), "organization_like_name")),
        F.when(near(rules.ADDRESS), F.array(single("address", "address_personal", line, "MEDIUM", 0.66, F.lit(0), F.lit(1), ["context:personal_address"], no))).otherwise(none),
    ]
    stop = F.array(single("", "", F.lit(""), "", 0.0, F.lit(0), F.lit(0), [], F.lit("placeholder_template")))
    return F.when(near(rules.PLACEHOLDERS), stop).otherwise(F.concat(*groups))


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """All items of all lines, accepted and rejected: doc_id, idx (line), ord (in the line), the item's fields, masked; start and end in the normal text."""
    some = scopes(docs, text).where(F.col("line").rlike(MAY_HOLD)).withColumn("low", F.lower("line"))
    # the items are the generator's own input: of a named column Spark would ask its size and whether it is null first, each time making all items anew
    rows = some.select("doc_id", "idx", "offset", F.posexplode(items(F.col("line"), F.col("low"))).alias("ord", "x")).select("doc_id", "idx", "ord", "offset", "x.*")
    return rows.withColumns({"masked": F.when(F.col("rejected").isNull(), rules.mask(F.col("type"), F.col("value"))), "start": F.col("offset") + F.col("start"), "end": F.col("offset") + F.col("end")}).drop("offset")


def evidence(found: DataFrame) -> DataFrame:
    return found.where(F.col("rejected").isNull()).drop("rejected")


def exclusions(found: DataFrame) -> DataFrame:
    """doc_id, reason, n, first (place of the first one, which settles ties)."""
    own = found.where(F.col("rejected").isNotNull())
    return own.groupBy("doc_id", F.col("rejected").alias("reason")).agg(F.count("*").alias("n"), F.min(F.struct("idx", "ord")).alias("first"))


def linked_medium(ev: DataFrame) -> DataFrame:
    """Medium evidence of lines that also have strong evidence: a semi-join."""
    s = ev.where("strength = 'STRONG'").select("doc_id", "idx")
    return ev.where("strength = 'MEDIUM'").join(s, ["doc_id", "idx"], "left_semi")


# Reasons of an assessment.
REASON_STRONG = "Обнаружены строго валидированные идентификаторы"
REASON_MEDIUM = "Подтверждены минимум 2 средних сигнала в одном локальном scope"
REASON_NONE = "Недостаточно подтверждений для precision-first классификации"


def _assessment(strong: Column, medium: Column, categories: Column) -> dict[str, Column]:
    """The fields that follow from the numbers of strong and medium evidence and the counts of the categories."""
    score = F.when(strong > 0, F.least(F.lit(100), 70 + strong * 8 + medium * 4)).when(medium >= 2, F.least(F.lit(100), 35 + medium * 10)).otherwise(0).cast("int")
    level, names = levels.protection_level(categories), F.array_sort(F.map_keys(categories))
    any_ = F.size(categories) > 0
    return {
        "has_personal_data": any_,
        "overall_confidence": F.when(strong > 0, "very_high").when(medium >= 2, "medium").otherwise("no_pd_or_weak"),
        "overall_risk_score": score,
        "categories": categories,
        "detected_categories": names,
        "legal_buckets_present": F.when(any_, F.array(F.lit("ordinary"))).otherwise(F.array().cast("array<string>")),
        "strongest_category": F.try_element_at(names, F.lit(1)),
        "short_reason": F.when(strong > 0, REASON_STRONG).when(medium >= 2, REASON_MEDIUM).otherwise(REASON_NONE),
        "protection_level": level,
        "protection_level_reason": levels.level_reason(level),
    }


def assess(conf: DataFrame) -> DataFrame:
    """One row for each document with confirmed evidence: score, confidence, categories (map of counts), level and the rest of the assessment."""
    counts = conf.groupBy("doc_id", "type").agg(F.count("*").alias("n"), F.count_if(F.col("strength") == "STRONG").alias("s"), F.count_if(F.col("strength") == "MEDIUM").alias("m"))
    pairs = F.array_sort(F.collect_list(F.struct(F.col("type").alias("key"), F.col("n").alias("value"))))
    per = counts.groupBy("doc_id").agg(F.map_from_entries(pairs).alias("categories"), F.sum("n").alias("hit_count"), F.sum("s").alias("strong"), F.sum("m").alias("medium"))
    return per.select("doc_id", "hit_count", *(v.alias(k) for k, v in _assessment(F.col("strong"), F.col("medium"), F.col("categories")).items()))


def top_reasons(excluded: DataFrame, n: int = 10) -> DataFrame:
    """doc_id, excluded_candidates (map), top_false_positive_sources (array, most frequent first, ties as first seen)."""
    entries = F.collect_list(F.struct((-F.col("n")).alias("a"), F.col("first").alias("b"), "reason", "n"))
    got = excluded.groupBy("doc_id").agg(F.array_sort(entries).alias("x"))
    pairs = F.transform("x", lambda e: F.struct(e["reason"].alias("reason"), e["n"].alias("n")))
    return got.select("doc_id", F.map_from_entries(pairs).alias("excluded_candidates"), F.slice(pairs, 1, n).alias("top_false_positive_sources"))


def whole_text_entities(docs: DataFrame, text: str = "text", config: Config = Config()) -> DataFrame:
    """Entities of the whole-text patterns: doc_id, type, value (unmasked), confidence, start, end, context, source. Texts of over a million characters are left out."""
    t = F.col(text)
    def entities_of(kind: str, pattern: str, base: float, words: list[str]) -> Column:
        def item(m: Column) -> Column:
            around = F.regexp_replace(snippet(t, m["start"], m["end"], config.context), r"(?U)^\s+|\s+$", "")
            sure = F.when(contains_any(F.lower(around), words), round(min(1.0, base + 0.05), 2)).otherwise(base)
            return F.struct(F.lit(kind).alias("type"), m["value"].alias("value"), sure.alias("confidence"), m["start"].alias("start"), m["end"].alias("end"), around.alias("context"))

        return F.filter(F.transform(matches(t, f"(?iu){pattern}"), item), lambda x: x["confidence"] >= config.least_confidence)

    parts = [entities_of(*x) for x in rules.WHOLE_TEXT]
    some = docs.where((F.length(t) > 0) & (F.length(t) <= 1_000_000))
    return some.select("doc_id", F.posexplode(F.concat(*parts)).alias("ord", "x")).select("doc_id", "ord", "x.*", F.lit("regex").alias("source"))


def rule_entities(conf: DataFrame) -> DataFrame:
    """Confirmed evidence as entities; the value is the mask."""
    return conf.select("doc_id", F.col("seq").alias("ord"), "type", F.col("masked").alias("value"), "confidence", "start", "end", F.lit("rule").alias("source"), "subtype", "reasons", "strength", rules.value_hash(F.col("value")).alias("value_hash"))


SOURCES = {"regex": 0, "nlp": 1, "rule": 2}


def merge_entities(*parts: DataFrame) -> DataFrame:
    """Of entities with one type, value and start the most confident stays, of equals the first of regex, nlp, rule."""
    cols = ["doc_id", "ord", "type", "value", "confidence", "start", "end", "source"]
    all_ = parts[0].select(*cols)
    for p in parts[1:]:
        all_ = all_.unionByName(p.select(*cols))
    order = F.create_map(*[F.lit(v) for kv in SOURCES.items() for v in kv])[F.col("source")]
    w = Window.partitionBy("doc_id", "type", "value", "start").orderBy(F.desc("confidence"), order, "ord")
    return all_.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def run_tagger(docs: DataFrame, hits: DataFrame | None = None, text: str = "text", config: Config = Config()) -> DataFrame:
    """doc_id, run: whether a document goes to the tagger - always, after enough pattern hits, or with a telling word."""
    own = docs.select("doc_id", F.lower(F.coalesce(F.col(text), F.lit(""))).alias("low"))
    n = F.lit(0)
    if hits is not None:
        own = own.join(hits.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left")
        n = F.coalesce("n", F.lit(0))
    run = F.lit(config.tagger_always) | (n >= config.tagger_hits) | contains_any(F.col("low"), list(config.tagger_words))
    return own.select("doc_id", run.alias("run"))


def _judged(found: DataFrame, mediums: int) -> DataFrame:
    """found with kept (whether a row is confirmed evidence) and _rank (its place among the confirmed); rejected rows stay, unconfirmed. One shuffle, by document."""
    doc, line = Window.partitionBy("doc_id"), Window.partitionBy("doc_id", "idx")
    good = F.col("rejected").isNull()
    strong, medium = good & (F.col("strength") == "STRONG"), good & (F.col("strength") == "MEDIUM")
    e = found.withColumns({"_s": F.max(strong).over(doc), "_ls": F.max(strong).over(line), "_m": F.count_if(medium).over(line)})
    keep = F.when(F.col("_s"), strong | (medium & F.col("_ls"))).otherwise((F.col("_m") >= mediums) & (medium | (good & (F.col("type") == "person_name"))))
    first, last = F.when(F.col("_s"), F.when(strong, 0).otherwise(1)).otherwise(0), F.when(F.col("_s") | medium, 0).otherwise(1)
    e = e.withColumns({"kept": keep, "_rank": F.struct(first.alias("a"), F.col("idx").alias("b"), last.alias("c"), F.col("ord").alias("d"))})
    same = Window.partitionBy("doc_id", "idx", "type", "masked", "kept").orderBy("_rank")
    return e.withColumn("kept", F.col("kept") & (F.row_number().over(same) == 1)).drop("_s", "_ls", "_m")


def confirmed(ev: DataFrame, mediums: int = 2) -> DataFrame:
    """Evidence that counts: with strong evidence in the document, that and the medium one of the same lines; else the medium evidence, and the names, of
    lines with enough of it. Of equal masks in a line the first stays. seq: the order of the results."""
    kept = _judged(ev if "rejected" in ev.columns else ev.withColumn("rejected", F.lit(None).cast("string")), mediums).where("kept")
    return kept.withColumn("seq", F.row_number().over(Window.partitionBy("doc_id").orderBy("_rank"))).drop("_rank", "kept", "rejected")


def detect(docs: DataFrame, text: str = "text", config: Config = Config()) -> DataFrame:
    """One row for every document: the assessment of the rules, the level, entities and diagnostics. The lines are searched once and their items shuffled once."""
    # a row for each document goes with its items, so that one without items, or without an id, has its group too
    found = _judged(candidates(docs, text).unionByName(docs.select("doc_id"), allowMissingColumns=True), config.mediums)
    part = F.struct("_rank", "idx", "type", "subtype", "masked", "strength", "confidence", "start", "end", "reasons", rules.value_hash(F.col("value")).alias("value_hash"))
    per = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("kept"), part))).alias("_c"), F.array_sort(F.collect_list(F.when(F.col("rejected").isNotNull(), F.struct("idx", "ord", F.col("rejected").alias("reason"))))).alias("_x"))
    kinds = F.array_sort(F.array_distinct(F.transform("_c", lambda c: c["type"])))
    counts = F.map_from_entries(F.transform(kinds, lambda k: F.struct(k, F.size(F.filter("_c", lambda c: c["type"] == k)).cast("long"))))
    strength = lambda s: F.size(F.filter("_c", lambda c: c["strength"] == s))
    why = F.array_distinct(F.transform("_x", lambda x: x["reason"]))  # in the order first seen
    n = F.transform(why, lambda r: F.struct(r.alias("reason"), F.size(F.filter("_x", lambda x: x["reason"] == r)).cast("long").alias("n")))
    ranked = F.array_sort(F.transform(n, lambda x, i: F.struct((-x["n"]).alias("a"), i.alias("b"), x["reason"].alias("reason"), x["n"].alias("n"))))
    fields = _assessment(strength("STRONG"), strength("MEDIUM"), counts)
    chain = F.transform(F.slice("_c", 1, 50), lambda c: F.struct(F.concat(F.lit("line:"), c["idx"]).alias("scope"), c["type"].alias("type"), c["strength"].alias("strength"), c["reasons"].alias("reasons"), c["masked"].alias("masked")))
    entities = F.transform(F.slice("_c", 1, config.entities), lambda c: F.struct(*(c[k].alias(k) for k in ("type", "subtype", "masked", "start", "end", "confidence", "reasons", "value_hash"))))
    return per.select(
        "doc_id", *(v.alias(k) for k, v in fields.items()), F.size("_c").cast("long").alias("hit_count"), F.map_from_entries(n).alias("excluded_candidates"),
        F.slice(F.transform(ranked, lambda x: F.struct(x["reason"].alias("reason"), x["n"].alias("n"))), 1, 10).alias("top_false_positive_sources"), chain.alias("evidence_chain"), entities.alias("entities"),
    )
