"""Documents and their expected assessments."""

import pytest
from pyspark.sql import functions as F

from veilscan.functions import levels, rules
from veilscan.functions.text import chunks, lines, matches, normalize, stream_chunks
from veilscan.operators import detect as dt

CASES = [
    ("Документ создан 12.03.2020", False, 0, 0, "УЗ-0"),
    ("Иванов Иван Иванович", False, 0, 0, "УЗ-0"),
    ("СНИЛС: 112-233-445 95", True, 78, 1, "УЗ-3"),
    ("карта 4111 1111 1111 1112", False, 0, 0, "УЗ-0"),
    ("ФИО: Иванов Иван Иванович | email: ivanov@gmail.com | тел: +7 999 111-22-33", True, 55, 3, "УЗ-4"),
    ("ФИО: Иванов Иван Иванович email: ivanov@gmail.com тел: +7 999 1112233", True, 55, 3, "УЗ-4"),
    ("Политика обработки ПДн: укажите <ФИО> и <дата рождения> в шаблоне", False, 0, 0, "УЗ-0"),
    ("ИНН: 500100732259", True, 78, 1, "УЗ-3"),
    ("support@example.com\n+7 (800) 555-35-35", False, 0, 0, "УЗ-0"),
    ("контакт: anna@mail.ru; alex@mail.ru", True, 0, 1, "УЗ-4"),  # equal masks fall together after the count
    ("дата рождения: 31.02.1980", False, 0, 0, "УЗ-0"),
    ("дата рождения: 31.02.1980 адрес проживания: Тверь", True, 55, 2, "УЗ-4"),
    ("P<RUSIVANOV<<IVAN<<<<<<<<<<<<<<", True, 78, 1, "УЗ-4"),
    ("карта 4111 1111 1111 1111 ", True, 78, 1, "УЗ-2"),
    ("", False, 0, 0, "УЗ-0"),
    (None, False, 0, 0, "УЗ-0"),
]


def test_cases(spark):
    rows = [(k, c[0]) for k, c in enumerate(CASES)]
    got = {r["doc_id"]: r for r in dt.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (text, has, score, hits, level) in enumerate(CASES):
        r = got[k]
        assert (r["has_personal_data"], r["overall_risk_score"], r["hit_count"], r["protection_level"]) == (has, score, hits, level), text


def test_exclusions(spark):
    rows = [(0, "почта anna@mail.ru"), (1, "дата рождения: 01.01.2013"), (2, "счет 40702810900000000001"), (3, "образец\nобразец 112-233-445 95"), (4, "112-233-445 95"), (5, "Министерство Обороны")]
    got = {r["doc_id"]: r["excluded_candidates"] for r in dt.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == {"email_without_person_context": 1} and got[1] == {"dob_age_implausible": 1} and got[2].get("account_without_bik") == 1
    assert got[3] == {"placeholder_template": 2} and got[4] == {"snils_without_context": 1} and got[5] == {"organization_like_name": 1}


def test_offsets_follow_normal_text(spark):
    df = spark.createDataFrame([(1, "  \t\r\n  СНИЛС:  112-233-445 95")], "doc_id long, text string")
    e = dt.evidence(dt.candidates(df)).first()
    assert (e["idx"], e["start"]) == (1, 2 + 7)  # the first raw line is one blank and its end; the stripped line is counted from its raw start


def test_levels(spark):
    row = lambda m: spark.range(1).select(F.create_map(*[F.lit(x).cast("bigint") if isinstance(x, int) else F.lit(x) for kv in m.items() for x in kv]).cast("map<string,bigint>").alias("m")).select(levels.protection_level(F.col("m"))).first()[0]
    assert row({"credit_card": 1, "email": 1}) == "УЗ-2" and row({"email": 3, "phone": 2}) == "УЗ-4" and row({"passport": 99}) == "УЗ-3" and row({"passport": 100}) == "УЗ-2" and row({"Bank Card": 1}) == "УЗ-2" and row({"dna": 1}) == "УЗ-1"
    assert spark.range(1).select(levels.protection_level(F.create_map().cast("map<string,bigint>"))).first()[0] == "УЗ-0"


@pytest.mark.parametrize("text", ["8 912 345 67 89 и 89123456789, 🙂 8(912)3456789", "", "нет"])
def test_matches_like_finditer(spark, text):
    import re

    want = [(m.group(0), m.start(), m.end()) for m in re.finditer(rules.PATTERNS["phone"], text)]
    got = spark.createDataFrame([(text,)], "t string").select(matches(F.col("t"), rules.PATTERNS["phone"]).alias("m")).first()["m"]
    assert [tuple(x) for x in got] == want


def test_many_matches_in_a_line(spark):
    text = " ".join(["user@mail.ru"] * 700)
    got = spark.createDataFrame([(text,)], "t string").select(matches(F.col("t"), rules.PATTERNS["email"]).alias("m")).first()["m"]
    assert [x["start"] for x in got] == [13 * k for k in range(700)]


def test_lines_like_splitlines(spark):
    text = "a\r\nb\rc\x1cd\x85e f\n\n g "
    got = spark.createDataFrame([(text,)], "t string").select(lines(normalize(F.col("t"))).alias("x")).first()["x"]
    assert [(x["idx"], x["text"]) for x in got] == [(i, s.strip()) for i, s in enumerate(text.splitlines()) if s.strip()]


def test_chunks(spark):
    df = spark.createDataFrame([("abcdefghij",)], "t string")
    got = df.select(chunks(F.col("t"), 4, 1).alias("c")).first()["c"]
    assert [(c["text"], c["start"], c["end"]) for c in got] == [("abcd", 0, 4), ("defg", 3, 7), ("ghij", 6, 10)] and [c["is_last"] for c in got] == [False, False, True]
    whole = df.select(chunks(F.col("t"), 100, 5).alias("c")).first()["c"]
    assert [(c["start"], c["end"], c["is_last"]) for c in whole] == [(0, 10, True)]
    # a text of exactly one window leaves its overlap as a chunk of its own
    exact = df.select(stream_chunks(F.col("t"), 10, 3).alias("c")).first()["c"]
    assert [(c["start"], c["end"]) for c in exact] == [(0, 10), (7, 10)]
    with pytest.raises(ValueError):
        chunks(F.col("t"), 0, 1)


def test_tagger_gate(spark):
    df = spark.createDataFrame([(1, "нейтральный текст " * 20), (2, "здесь персональные данные и паспорт"), (3, "просто текст")], "doc_id long, text string")
    hits = spark.createDataFrame([(3,)], "doc_id long")
    assert {r["doc_id"]: r["run"] for r in dt.run_tagger(df, hits).collect()} == {1: False, 2: True, 3: True}
    assert all(r["run"] for r in dt.run_tagger(df, config=dt.Config(tagger_always=True)).collect())


def test_ensemble_blank_and_warnings(spark):
    from veilscan.operators import ensemble as en

    docs = spark.createDataFrame([(1, ""), (2, None), (3, "СНИЛС: 112-233-445 95"), (4, "x" * 1_000_001), (5, "Паспорт: " + "y" * 60_000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in en.detect_all(docs, config=dt.Config(whole_text=True, tagger=True), tag=lambda t: []).collect()}
    assert all(got[k]["protection_level"] is None and got[k]["warnings"] == [] and got[k]["categories"] == {} for k in (1, 2))
    assert got[3]["protection_level"] == "УЗ-3" and en.TOO_LONG in got[4]["warnings"] and "Text truncated to 50000 chars for NLP" in got[5]["warnings"]
    bare = en.detect_all(docs.where("doc_id = 5"), config=dt.Config(tagger=True)).first()
    assert bare["warnings"] == [en.NO_MODELS]


def test_one_text(spark):
    from veilscan.operators.ensemble import detect_personal_data

    got = detect_personal_data(spark, "СНИЛС: 112-233-445 95")
    assert got["detected"] and got["categories"] == {"snils": 1} and got["protection_level"] == "УЗ-3" and got["entities"][0]["masked"].startswith("11***") and got["protection_level_reason"]
    rules_only = detect_personal_data(spark, "ничего", use_ensemble=False)
    assert not rules_only["detected"] and rules_only["protection_level"] == "УЗ-0" and rules_only["entity_count"] == 0
    assert detect_personal_data(spark, "")["protection_level"] is None
