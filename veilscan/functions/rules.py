"""The rules of the detector: patterns, word lists, checks, masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import digits

# Patterns of the candidates.
PATTERNS = {
    "snils": r"\b\d{3}[\s\-]?\d{3}[\s\-]?\d{3}[\s\-]?\d{2}\b",
    "inn": r"\b\d{10}\b|\b\d{12}\b",
    "card": r"\b(?:\d[\s\-]?){13,19}\b",
    "mrz": r"^[A-Z0-9<]{30,44}$",
    "passport": r"\b\d{2}\s?\d{2}\s?\d{6}\b",
    "account": r"\b\d{20}\b",
    "bik": r"\b\d{9}\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "phone": r"(?:\+7|8)\s*\(?\d{3}\)?[\s\-]*\d{3}[\s\-]*\d{2}[\s\-]*\d{2}",
    "dob": r"\b(?:0?[1-9]|[12]\d|3[01])[\.\-/](?:0?[1-9]|1[0-2])[\.\-/](?:19\d{2}|20\d{2})\b",
    "fio": r"\b[А-ЯЁ][а-яё]{2,}\s+[А-ЯЁ][а-яё]{2,}(?:\s+[А-ЯЁ][а-яё]{2,})?\b",
}
# Word lists, matched as substrings of the lower-cased line.
PERSON = ["фио", "сотрудник", "пациент", "контакт", "клиент", "гражданин", "person"]
BIRTH = ["дата рождения", "г.р", "родился", "родилась", "birth", "dob"]
ADDRESS = ["адрес проживания", "адрес регистрации", "место жительства", "прописка"]
SNILS = ["снилс"]
INN = ["инн"]
PASSPORT = ["паспорт", "серия", "номер", "выдан", "код подразделения"]
ACCOUNT = ["счет", "р/с", "расчетный счет", "банк", "бик"]
PLACEHOLDERS = ["example", "sample", "demo", "шаблон", "образец", "<фио>", "заполните"]
ORGANIZATION = ["ооо", "ао", "пао", "департамент", "управление", "министерство", "филиал"]
MAILBOXES = ["info", "support", "sales", "hr", "contact", "hello"]
# Patterns of the whole-text detector, (type, pattern, confidence, words around).
WHOLE_TEXT = [
    ("passport", r"\b(\d{4})[\s\-]?(\d{6})\b", 0.75, ["паспорт", "серия", "номер", "документ", "удостоверение", "issued", "выдан", "passport"]),
    ("snils", r"\b(\d{3})[\s\-]?(\d{3})[\s\-]?(\d{3})[\s\-]?(\d{2})\b", 0.75, ["снилс", "страховой", "пенсионный", "номер", "snils", "индивидуальный"]),
    ("inn", r"\b(\d{10})\b|\b(\d{12})\b", 0.75, ["инн", "налогоплательщик", "налог", "код", "inn", "идентификационный"]),
    ("phone", r"(\+7|8)[\s\.\-]?\(?\d{3}\)?[\s\.\-]?\d{3}[\s\.\-]?\d{2}[\s\.\-]?\d{2}", 0.75, ["телефон", "тел", "моб", "контакт", "phone", "mobile"]),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", 0.85, ["email", "почта", "электронная", "адрес", "mail"]),
    ("date_of_birth", r"\b(\d{1,2})[\.\-\/](\d{1,2})[\.\-\/](\d{4})\b", 0.70, ["рождения", "родился", "дата", "birth", "born", "род"]),
]
# Other names of entity types; weights of the tax number's check digits.
TYPE_NAMES = {"PER": "person_name", "ORG": "organization", "LOC": "location", "DATE": "date", "inn_individual": "inn", "inn_legal": "inn", "phone_ru": "phone"}
INN_10 = [2, 4, 10, 3, 5, 9, 4, 6, 8]
INN_12 = [7, 2, 4, 10, 3, 5, 9, 4, 6, 8]
INN_12_LAST = [3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8]


def _digit(x: Column, i: int) -> Column:
    return F.substring(x, i + 1, 1).cast("int")


def _weighted(x: Column, weights: list[int]) -> Column:
    out = F.lit(0)
    for i, w in enumerate(weights):
        out = out + _digit(x, i) * w
    return out


def snils_valid(x: Column) -> Column:
    """x: digits only. Numbers up to 1001998 are checked modulo 101 as a whole."""
    total = _weighted(x, list(range(9, 0, -1)))
    expected = F.when(total < 100, total).when(total % 101 == 100, 0).otherwise(total % 101)
    number, control = F.left(x, F.lit(9)).cast("int"), F.right(x, F.lit(2)).cast("int")
    return F.coalesce(F.length(x) == 11, F.lit(False)) & F.when(number <= 1001998, control == number % 101).otherwise(expected == control)


def inn_valid(x: Column) -> Column:
    ten = _weighted(x, INN_10) % 11 % 10 == _digit(x, 9)
    twelve = (_weighted(x, INN_12) % 11 % 10 == _digit(x, 10)) & (_weighted(x, INN_12_LAST) % 11 % 10 == _digit(x, 11))
    return F.when(F.length(x) == 10, ten).when(F.length(x) == 12, twelve).otherwise(False)


def birth_plausible(x: Column) -> Column:
    """Year 1900 to 2012, day and month in range; the calendar is not consulted."""
    p = F.split(x, r"[\.\-/]")
    return (F.size(p) == 3) & p[2].cast("int").between(1900, 2012) & p[0].cast("int").between(1, 31) & p[1].cast("int").between(1, 12)


def phone_normal(x: Column) -> Column:
    return F.concat(F.lit("+"), F.regexp_replace(digits(x), "^8", "7"))


def mask(kind: Column, x: Column) -> Column:
    d = digits(x)
    number = F.when(F.length(d) <= 4, F.repeat(F.lit("*"), F.length(d))).otherwise(F.concat(F.left(d, F.lit(2)), F.lit("***"), F.right(d, F.lit(2))))
    plain = F.when(F.length(x) > 3, F.concat(F.left(x, F.lit(2)), F.lit("***"))).otherwise(F.lit("***"))
    return (
        F.when(kind.isin("snils", "inn", "passport", "payment_card_number", "bank_account") & (d != ""), number)
        .when((kind == "email") & x.contains("@"), F.concat(F.left(x, F.lit(1)), F.lit("***@"), F.regexp_extract(x, "(?s)^[^@]*@(.*)$", 1)))
        .when((kind == "phone") & (d != ""), F.concat(F.lit("+7***"), F.right(d, F.lit(4))))
        .otherwise(plain)
    )


def value_hash(x: Column) -> Column:
    return F.left(F.sha2(x, 256), F.lit(16))


def entity_alias(kind: Column) -> Column:
    """Tagger's and pattern's names of types to the engine's."""
    return F.coalesce(F.create_map(*[F.lit(v) for kv in TYPE_NAMES.items() for v in kv])[kind], F.lower(kind))


def entity_value(x: Column) -> Column:
    """Compared without case and with single spaces."""
    return F.trim(F.regexp_replace(F.lower(x), r"(?U)\s+", " "))


def position_bucket(start: Column, width: int = 25) -> Column:
    return F.floor(start / (width if width > 0 else 25)).cast("long")
