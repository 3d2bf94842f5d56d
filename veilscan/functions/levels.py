"""Categories and protection levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Classes of categories.
CLASSES = {
    "biometric": ["fingerprint", "iris", "voice_sample", "face_geometry", "dna"],
    "special": ["health", "religion", "political_views", "race", "nationality"],
    "payment": ["credit_card", "bank_account", "payment_card_number", "cvv"],
    "government": ["passport", "snils", "inn", "driver_license", "military_id"],
    "regular": ["person_name", "email", "phone", "address", "date_of_birth", "organization", "location"],
}
# Other names of categories, levels and their reasons.
ALIASES = {"card_number": "credit_card", "payment_card": "payment_card_number", "bank_card": "payment_card_number", "bankaccount": "bank_account"}
LEVELS = {
    "УЗ-1": "Специальные/биометрические данные (высокий риск)",
    "УЗ-2": "Платежные данные или гос. данные в больших объемах",
    "УЗ-3": "Гос. идентификаторы или обычные ПДн",
    "УЗ-4": "Обычные ПДн в небольших объемах",
    "УЗ-0": "ПДн не обнаружены (базовый уровень)",
}
SENSITIVE = ["passport", "snils", "inn", "credit_card", "bank_account"]
LARGE = 100


def category_key(key: Column) -> Column:
    """Stripped, lower case, underscores for spaces and dashes, other names resolved."""
    k = F.translate(F.lower(F.trim(key)), " -", "__")
    return F.coalesce(F.create_map(*[F.lit(v) for kv in ALIASES.items() for v in kv])[k], k)


def taxonomy(spark: SparkSession) -> DataFrame:
    """category, class: as many rows as CLASSES has names."""
    rows = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(k).alias("class")) for k, names in CLASSES.items() for c in names])
    return spark.range(1).select(F.inline(rows))


def class_count(counts: Column, name: str) -> Column:
    """Sum over a map<category, count> of the categories of a class."""
    own = F.filter(F.map_entries(counts), lambda e: category_key(e["key"]).isin(CLASSES[name]))
    return F.aggregate(own, F.lit(0).cast("long"), lambda a, e: a + e["value"])


def protection_level(counts: Column) -> Column:
    """Level of a map<category, count>."""
    gov, regular = class_count(counts, "government"), class_count(counts, "regular")
    total = F.aggregate(F.map_values(counts), F.lit(0).cast("long"), lambda a, v: a + v)
    return (
        F.when((class_count(counts, "biometric") > 0) | (class_count(counts, "special") > 0), "УЗ-1")
        .when((class_count(counts, "payment") > 0) | (gov >= LARGE), "УЗ-2")
        .when((gov > 0) | (regular >= LARGE), "УЗ-3")
        .when(total > 0, "УЗ-4")
        .otherwise("УЗ-0")
    )


def level_reason(level: Column) -> Column:
    return F.create_map(*[F.lit(v) for kv in LEVELS.items() for v in kv])[level]


def has_sensitive(counts: Column, level: Column) -> Column:
    return F.exists(F.map_keys(counts), lambda k: k.isin(SENSITIVE)) | level.isin("УЗ-1", "УЗ-2", "УЗ-3")
