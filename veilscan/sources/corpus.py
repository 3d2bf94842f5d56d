"""A deterministic corpus with identifiers, made from customer keys; the same in Spark and in SQL (see queries)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules

KINDS = 12


def _no_eights(x: Column) -> Column:
    """Digits without 8, which could begin a phone number."""
    return F.translate(x, "8", "3")


def nine(k: Column) -> Column:
    return _no_eights(F.lpad(((k * 7919 + 100000007) % 1000000000).cast("string"), 9, "0"))


def snils_check(n: Column) -> Column:
    """Check number of nine digits, not yet cut to the two that are written (of small numbers it can be 100)."""
    total = rules._weighted(n, list(range(9, 0, -1)))
    check = F.when(total < 100, total).when(total % 101 == 100, 0).otherwise(total % 101)
    return F.when(n.cast("int") <= 1001998, n.cast("int") % 101).otherwise(check)


def inn_check(n: Column, weights: list[int]) -> Column:
    return (rules._weighted(n, weights) % 11 % 10).cast("string")


def card_check(head: Column) -> Column:
    """Last digit after fifteen."""
    double = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    total = F.lit(0)
    for i in range(15):
        d = rules._digit(head, i)
        total = total + (F.element_at(F.array(*map(F.lit, double)), d + 1) if i % 2 == 0 else d)
    return ((10 - total % 10) % 10).cast("string")


def dealt(keys: DataFrame) -> DataFrame:
    """Keys dealt by doc_id: a small file of them is one task, while the work on their documents is long. What groups by doc_id later needs no other shuffle."""
    spark = keys.sparkSession
    return keys.repartition(min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(32, 4 * spark.sparkContext.defaultParallelism)), "doc_id")


def corpus(customer: DataFrame) -> DataFrame:
    """doc_id, path, text: one document for each customer, of kind doc_id % 12, with a name in the second line of every third."""
    base = dealt(customer.select(F.col("c_custkey").alias("doc_id"))).withColumn("nine", nine(F.col("doc_id")))
    n = F.col("nine")
    base = base.withColumns({"check": snils_check(n), "ten": inn_check(n, rules.INN_10), "eleven": inn_check(F.concat(n, F.lit("1")), rules.INN_12), "head": F.concat(F.lit("4"), n, F.lit("12345"))})
    base = base.withColumns({"twelve": inn_check(F.concat(n, F.lit("1"), "eleven"), rules.INN_12_LAST), "luhn": card_check(F.col("head"))})
    k, nine_, last = F.col("doc_id"), n, F.col("check")
    shown = F.concat_ws("-", F.substring(n, 1, 3), F.substring(n, 4, 3), F.substring(n, 7, 3))
    good, bad = (F.lpad(x.cast("string"), 2, "0") for x in (last, (last + 1) % 100))
    texts = [
        F.concat(F.lit("СНИЛС: "), shown, F.lit(" "), good),
        F.concat(F.lit("СНИЛС: "), shown, F.lit(" "), bad),
        F.concat(F.lit("ИНН: "), n, F.col("ten")),
        F.concat(F.lit("ИНН "), n, F.lit("1"), "eleven", "twelve"),
        F.concat(F.lit("клиент: почта User"), k, F.lit("@mail.ru тел: 8 (9"), F.substring(nine_, 1, 2), F.lit(") "), F.substring(nine_, 3, 3), F.lit("-"), F.substring(nine_, 6, 2), F.lit("-"), F.substring(nine_, 8, 2)),
        F.concat(F.lit("почта: info@firm"), k, F.lit(".ru")),
        F.concat(F.lit("образец: ИНН "), n, F.col("ten")),
        F.concat(F.lit("счет 40702"), nine_, F.lit("000001 БИК "), nine_),
        F.concat(F.lit("дата рождения: 12.03."), (k % 50 + 1960).cast("string"), F.lit(" адрес проживания: город")),
        F.concat(F.lit("паспорт серия 45 10 "), F.substring(nine_, 1, 6)),
        F.concat(F.lit("P<RUSIVANOV<<IVAN<<<<<<"), nine_, F.lit("<<<<")),
        F.concat(F.lit("карта "), "head", "luhn"),
    ]
    text = texts[-1]
    for v, t in reversed(list(enumerate(texts[:-1]))):
        text = F.when(k % KINDS == v, t).otherwise(text)
    text = F.concat(text, F.when(k % 3 == 0, "\nИванов Иван Иванович").otherwise(""))
    return base.select("doc_id", F.concat(F.lit("/data/"), k, F.element_at(F.array(*map(F.lit, (".txt", ".csv", ".html", ""))), (k % 4 + 1).cast("int"))).alias("path"), text.alias("text"))
