"""Queries of the detection engine, each with the SQL that gives the same rows.

The SQL derives what it can from the corpus's construction (kinds of documents, arithmetic on keys) rather than from the engine's patterns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import levels, rules
from .functions import text as tx
from .operators import detect as dt
from .operators import ensemble as en
from .operators import merge as mg
from .operators import report as rp
from .plans import scan
from .sources import files as fl
from .sources.corpus import corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The corpus in SQL: doc_id, v (kind), n (nine digits), check numbers, one (first line), name (whether a second line has a name), text, path.
CORPUS = """
with b0 as (select c_custkey as k, translate(lpad(cast((c_custkey * 7919 + 100000007) % 1000000000 as varchar), 9, '0'), '8', '3') as n from customer),
b1 as (select *, list_transform(string_split(n, ''), lambda x: cast(x as integer)) as d, list_transform(string_split('4' || n || '12345', ''), lambda x: cast(x as integer)) as e from b0),
b2 as (select *, list_sum(list_transform(range(1, 10), lambda i: d[i] * (10 - i))) as t,
  cast(list_sum(list_transform(range(1, 10), lambda i: d[i] * [2,4,10,3,5,9,4,6,8][i])) % 11 % 10 as integer) as ten,
  cast((list_sum(list_transform(range(1, 10), lambda i: d[i] * [7,2,4,10,3,5,9,4,6][i])) + 8) % 11 % 10 as integer) as eleven,
  cast((10 - list_sum(list_transform(range(1, 16), lambda i: case when i % 2 = 1 then e[i] * 2 - case when e[i] > 4 then 9 else 0 end else e[i] end)) % 10) % 10 as integer) as luhn from b1),
b3 as (select *, cast(case when cast(n as integer) <= 1001998 then cast(n as integer) % 101 when t < 100 then t when t % 101 = 100 then 0 else t % 101 end as integer) as chk,
  cast((list_sum(list_transform(range(1, 10), lambda i: d[i] * [3,7,2,4,10,3,5,9,4][i])) + 6 + eleven * 8) % 11 % 10 as integer) as twelve from b2),
b4 as (select *, k % 12 as v, substr(n, 1, 3) || '-' || substr(n, 4, 3) || '-' || substr(n, 7, 3) as shown, lpad(cast(chk as varchar), 2, '0') as c2, lpad(cast((chk + 1) % 100 as varchar), 2, '0') as bad,
  n || ten as inn10, n || '1' || eleven || twelve as inn12, '4' || n || '12345' || luhn as card, '40702' || n || '000001' as account, k % 3 = 0 as name from b3),
b5 as (select *, case v when 0 then 'СНИЛС: ' || shown || ' ' || c2 when 1 then 'СНИЛС: ' || shown || ' ' || bad when 2 then 'ИНН: ' || inn10 when 3 then 'ИНН ' || inn12
  when 4 then 'клиент: почта User' || k || '@mail.ru тел: 8 (9' || substr(n, 1, 2) || ') ' || substr(n, 3, 3) || '-' || substr(n, 6, 2) || '-' || substr(n, 8, 2) when 5 then 'почта: info@firm' || k || '.ru'
  when 6 then 'образец: ИНН ' || inn10 when 7 then 'счет ' || account || ' БИК ' || n when 8 then 'дата рождения: 12.03.' || (k % 50 + 1960) || ' адрес проживания: город'
  when 9 then 'паспорт серия 45 10 ' || substr(n, 1, 6) when 10 then 'P<RUSIVANOV<<IVAN<<<<<<' || n || '<<<<' else 'карта ' || card end as one from b4),
corp as (select k as doc_id, *, one || case when name then chr(10) || 'Иванов Иван Иванович' else '' end as text, '/data/' || k || ['.txt', '.csv', '.html', ''][k % 4 + 1] as path from b5),
ev as (
  select doc_id, 'snils' as type, substr(n, 1, 2) || '***' || c2 as masked, 'STRONG' as strength, 0.97 as confidence, 7 as a, 21 as z, shown || ' ' || c2 as value, 0 as line from corp where v = 0
  union all select doc_id, 'inn', substr(n, 1, 2) || '***' || right(inn10, 2), 'STRONG', 0.95, 5, 15, inn10, 0 from corp where v = 2
  union all select doc_id, 'inn', substr(n, 1, 2) || '***' || right(inn12, 2), 'STRONG', 0.95, 4, 16, inn12, 0 from corp where v = 3
  union all select doc_id, 'email', 'u***@mail.ru', 'MEDIUM', 0.72, 14, 14 + length('User' || k || '@mail.ru'), 'user' || k || '@mail.ru', 0 from corp where v = 4
  union all select doc_id, 'phone', '+7***' || right(n, 4), 'MEDIUM', 0.7, 14 + length('User' || k || '@mail.ru тел: '), length(one), '+79' || n, 0 from corp where v = 4
  union all select doc_id, 'bank_account', '40***01', 'STRONG', 0.91, 5, 25, account, 0 from corp where v = 7
  union all select doc_id, 'date_of_birth', '12***', 'MEDIUM', 0.68, 15, 25, substr(one, 16, 10), 0 from corp where v = 8
  union all select doc_id, 'address', 'да***', 'MEDIUM', 0.66, 0, 1, one, 0 from corp where v = 8
  union all select doc_id, 'passport', '45***' || substr(n, 5, 2), 'STRONG', 0.92, 14, 26, substr(one, 15), 0 from corp where v = 9
  union all select doc_id, 'mrz', 'P<***', 'STRONG', 0.93, 0, length(one), one, 0 from corp where v = 10
  union all select doc_id, 'payment_card_number', substr(card, 1, 2) || '***' || right(card, 2), 'STRONG', 0.96, 6, 22, card, 0 from corp where v = 11
  union all select doc_id, 'person_name', 'Ив***', 'WEAK', 0.45, length(one) + 1, length(one) + 21, 'Иванов Иван Иванович', 1 from corp where name),
ex as (select doc_id, 'snils_checksum_fail' as reason from corp where v = 1 union all select doc_id, 'passport_without_context' from corp where v = 2 union all select doc_id, 'generic_email' from corp where v = 5
  union all select doc_id, 'placeholder_template' from corp where v = 6),
found as (select doc_id, path, v, case when v in (4, 8) then 55 when v in (1, 5, 6) then 0 else 78 end as score, case when v in (4, 8) then 2 when v in (1, 5, 6) then 0 else 1 end as hits,
  case when v in (4, 8, 10) then 'УЗ-4' when v in (1, 5, 6) then 'УЗ-0' when v in (7, 11) then 'УЗ-2' else 'УЗ-3' end as level,
  case v when 0 then 'snils=1' when 2 then 'inn=1' when 3 then 'inn=1' when 4 then 'email=1; phone=1' when 7 then 'bank_account=1' when 8 then 'address=1; date_of_birth=1' when 9 then 'passport=1' when 10 then 'mrz=1' when 11 then 'payment_card_number=1' else '' end as cats,
  case when v in (4, 8) then 'Подтверждены минимум 2 средних сигнала в одном локальном scope' when v in (1, 5, 6) then 'Недостаточно подтверждений для precision-first классификации' else 'Обнаружены строго валидированные идентификаторы' end as reason from corp)
"""


def query(name: str, sql: str | None = None):
    def take(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return take


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(_t(spark, sf_dir, "customer"))


def _long(**cols):
    return [F.col(c).cast("long").alias(n) if isinstance(c, str) else c.cast("long").alias(n) for n, c in cols.items()]


# ---------------------------------------------------------------- text

NORMAL = "regexp_replace(replace(coalesce(text, ''), chr(160), ' '), '[ \\t]+', ' ', 'g')"
LINES = f"select doc_id, unnest(list_zip(range(len(l)), l), recursive := false) as x from (select doc_id, string_split_regex({NORMAL}, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') as l from documents)"


@query("text_normalize_stats", f"select doc_id, cast(length({NORMAL}) as bigint) as n, left(sha256({NORMAL}), 16) as digest from documents")
def _(spark, sf_dir):
    n = tx.normalize(F.col("text"))
    return _t(spark, sf_dir, "documents").select("doc_id", F.length(n).cast("long").alias("n"), rules.value_hash(n).alias("digest"))


@query("scope_split", f"select doc_id, cast(count(*) as bigint) as lines, cast(max(x[1]) as bigint) as last_idx, cast(sum(length(trim(x[2], ' '))) as bigint) as chars from ({LINES}) where trim(x[2], ' ') <> '' group by doc_id")
def _(spark, sf_dir):
    s = dt.scopes(_t(spark, sf_dir, "documents"))
    return s.groupBy("doc_id").agg(F.count("*").alias("lines"), F.max("idx").cast("long").alias("last_idx"), F.sum(F.length("line")).alias("chars"))


def _chunk_sql(size: int, overlap: int) -> str:
    step = size - overlap
    n = f"cast(1 + ceil(greatest(0, length(text) - {size}) / {step}.0) as bigint)"
    return f"""select doc_id, i as chunk_id, cast(i * {step} as bigint) as chunk_start, cast(least(i * {step} + {size}, length(text)) as bigint) as chunk_end, i = n - 1 as is_last, left(sha256(substr(text, i * {step} + 1, {size})), 16) as digest
from (select doc_id, text, {n} as n, unnest(range({n})) as i from documents)"""


@query("chunk_windows_generic", _chunk_sql(1200, 50))
def _(spark, sf_dir):
    return _chunked(spark, sf_dir, tx.chunks(F.col("text"), 1200, 50))


def _chunked(spark, sf_dir, cut):
    c = _t(spark, sf_dir, "documents").select("doc_id", F.explode(cut).alias("c"))
    return c.select("doc_id", F.col("c.chunk_id").cast("long").alias("chunk_id"), F.col("c.start").cast("long").alias("chunk_start"), F.col("c.end").cast("long").alias("chunk_end"), F.col("c.is_last").alias("is_last"), rules.value_hash(F.col("c.text")).alias("digest"))


@query(
    "chunk_windows_stream",
    """with d as (select doc_id, text, length(text) as n, case when length(text) >= 1200 then (length(text) - 1200) // 1150 + 1 else 0 end as full_ from documents),
c as (select doc_id, text, n, full_, unnest(range(full_ + case when full_ * 1150 < n then 1 else 0 end)) as i from d)
select doc_id, i as chunk_id, cast(i * 1150 as bigint) as chunk_start, cast(least(i * 1150 + 1200, n) as bigint) as chunk_end, i >= full_ as is_last, left(sha256(substr(text, i * 1150 + 1, 1200)), 16) as digest from c""",
)
def _(spark, sf_dir):
    return _chunked(spark, sf_dir, tx.stream_chunks(F.col("text"), 1200, 50))


@query("snippet", "select doc_id, substr(text, 21, 180) as snip from documents")
def _(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", tx.snippet(F.col("text"), F.lit(100), F.lit(120), 80).alias("snip"))


@query(
    "language_guess",
    """with c as (select length(regexp_replace(text, '[^\\x{0400}-\\x{04ff}]', '', 'g')) as c, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) as a from (select text from documents union all select text from (%s select text from corp)))
select case when c + a = 0 then null when c / (c + a) > 0.7 then 'rus' when c / (c + a) < 0.3 then 'eng' else 'mixed' end as guess, cast(count(*) as bigint) as n from c group by 1""" % CORPUS,
)
def _(spark, sf_dir):
    both = _t(spark, sf_dir, "documents").select("text").union(_corpus(spark, sf_dir).select("text"))
    return both.groupBy(tx.guess_language(F.col("text")).alias("guess")).agg(F.count("*").alias("n"))


@query("word_char_counts", "select doc_id, cast(len(regexp_extract_all(text, '\\S+')) as bigint) as words, cast(length(text) as bigint) as chars from documents")
def _(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", tx.word_count(F.col("text")).cast("long").alias("words"), F.length("text").cast("long").alias("chars"))


@query(
    "ocr_cleanup",
    "select o_orderkey, trim(replace(replace(replace(replace(cast(o_orderkey as varchar) || 'O1 ' || o_orderpriority, ' ', '_'), '_', ' '), 'O1', '01'), '  ', ' ')) as cleaned from orders",
)
def _(spark, sf_dir):
    raw = F.concat(F.col("o_orderkey").cast("string"), F.lit("O1  "), "o_orderpriority")
    # an O between digits, and spaces between digits, go; the priority begins with a digit
    return _t(spark, sf_dir, "orders").select("o_orderkey", tx.clean_ocr(raw).alias("cleaned"))


SQL["ocr_cleanup"] = "select o_orderkey, case when o_orderpriority ~ '^[0-9]' then cast(o_orderkey as varchar) || '01' || o_orderpriority else cast(o_orderkey as varchar) || '01 ' || o_orderpriority end as cleaned from orders"


@query("value_normalize", "select p_partkey, trim(regexp_replace(lower('  ' || p_name || '   ' || p_type || ' '), '\\s+', ' ', 'g')) as value, cast(p_partkey // 25 as bigint) as bucket from part")
def _(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", rules.entity_value(F.concat(F.lit("  "), "p_name", F.lit("   "), "p_type", F.lit(" "))).alias("value"), rules.position_bucket(F.col("p_partkey")).alias("bucket"))


@query("looks_like_name", "select name, cast(count(*) as bigint) as n from (select (['Иванов Иван', 'иванов иван', 'Иванов', 'Anna Maria Berg', 'ООО Ромашка', 'Anna Berg von Stein Lo'])[c_custkey % 6 + 1] as w, c_custkey % 6 in (0, 3) as name from customer) group by name")
def _(spark, sf_dir):
    words = F.array(*map(F.lit, ["Иванов Иван", "иванов иван", "Иванов", "Anna Maria Berg", "ООО Ромашка", "Anna Berg von Stein Lo"]))
    return _t(spark, sf_dir, "customer").select(tx.looks_like_name(F.element_at(words, (F.col("c_custkey") % 6 + 1).cast("int"))).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- rules on documents

CARD_LINES = f"""c as (select doc_id, regexp_replace(unnest(regexp_extract_all(trim(x[2], ' '), '\\b(?:[0-9][\\s\\-]?){{13,19}}\\b')), '[^0-9]', '', 'g') as d from ({LINES})
  where not regexp_matches(lower(x[2]), 'example|sample|demo|шаблон|образец|<фио>|заполните')),
l as (select doc_id, d, list_sum(list_transform(range(1, length(d) + 1), lambda i: case when (length(d) - i) % 2 = 1 then (cast(d[i] as integer) * 2) % 10 + (cast(d[i] as integer) * 2) // 10 else cast(d[i] as integer) end)) % 10 as luhn from c)"""


@query("card_luhn_documents", f"with {CARD_LINES} select doc_id, left(sha256(d), 16) as value_hash, left(d, 2) || '***' || right(d, 2) as masked from l where length(d) between 16 and 19 and luhn = 0")
def _(spark, sf_dir):
    e = dt.evidence(dt.candidates(_t(spark, sf_dir, "documents"))).where("type = 'payment_card_number'")
    return e.select("doc_id", rules.value_hash(F.col("value")).alias("value_hash"), "masked")


@query("card_exclusions", f"with {CARD_LINES} select case when length(d) not between 16 and 19 then 'card_length_fail' else 'card_luhn_fail' end as reason, cast(count(*) as bigint) as n from l where length(d) not between 16 and 19 or luhn <> 0 group by 1")
def _(spark, sf_dir):
    x = dt.candidates(_t(spark, sf_dir, "documents")).where(F.col("rejected").startswith("card_"))
    return x.groupBy(F.col("rejected").alias("reason")).agg(F.count("*").alias("n"))


@query("card_findings", f"with {CARD_LINES}, g as (select distinct doc_id, d from l where length(d) between 16 and 19 and luhn = 0) select doc_id, true as has_personal_data, 'very_high' as overall_confidence, 'УЗ-2' as protection_level from g group by doc_id")
def _(spark, sf_dir):
    return dt.detect(_t(spark, sf_dir, "documents")).where("has_personal_data").select("doc_id", "has_personal_data", "overall_confidence", "protection_level")


# ---------------------------------------------------------------- rules on the corpus


@query("corpus_text", CORPUS + "select doc_id, path, text from corp")
def _(spark, sf_dir):
    return _corpus(spark, sf_dir)


def _found(spark, sf_dir):
    return dt.candidates(_corpus(spark, sf_dir))


def _evidence_of(kind: str):
    def run(spark, sf_dir):
        e = dt.evidence(_found(spark, sf_dir)).where(F.col("type") == kind)
        return e.select("doc_id", "masked", "strength", "confidence", *_long(a="start", z="end"), rules.value_hash(F.col("value")).alias("value_hash"))

    return run


for _name, _kind in {"snils_valid": "snils", "inn_valid": "inn", "passport_ctx": "passport", "account_bik_pairs": "bank_account", "mrz_shape": "mrz", "email_ctx": "email", "phone_normalized": "phone", "dob_plausible": "date_of_birth", "fio_weak": "person_name", "address_ctx": "address", "card_valid": "payment_card_number"}.items():
    QUERIES[_name] = _evidence_of(_kind)
    SQL[_name] = CORPUS + f"select doc_id, masked, strength, cast(confidence as double) as confidence, cast(a as bigint) as a, cast(z as bigint) as z, left(sha256(value), 16) as value_hash from ev where type = '{_kind}'"


@query("exclusion_topk", CORPUS + "select reason, cast(count(*) as bigint) as n from ex group by reason order by n desc, reason limit 10")
def _(spark, sf_dir):
    return dt.exclusions(_found(spark, sf_dir)).groupBy("reason").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "reason").limit(10)


def _confirmed(spark, sf_dir):
    return dt.confirmed(dt.evidence(_found(spark, sf_dir)))


@query("confirm_strong", CORPUS + "select doc_id, type, masked from ev where strength = 'STRONG'")
def _(spark, sf_dir):
    return _confirmed(spark, sf_dir).where("strength = 'STRONG'").select("doc_id", "type", "masked")


@query("confirm_medium", CORPUS + "select doc_id, type, masked from ev where strength = 'MEDIUM'")
def _(spark, sf_dir):
    return _confirmed(spark, sf_dir).where("strength <> 'STRONG'").select("doc_id", "type", "masked")


@query(
    "linked_medium_semi",
    CORPUS + """, strong as (select distinct corp.doc_id, k from ev join corp using (doc_id) where strength = 'STRONG' and contains(one, ':'))
  select doc_id, 'email' as type, 'u***@mail.ru' as masked from strong union all select doc_id, 'phone', '+7***' || '4567' from strong""",
)
def _(spark, sf_dir):
    # contact data at the end of each first line; it counts in lines of the form key: value
    docs = _corpus(spark, sf_dir).select("doc_id", F.regexp_replace("text", r"^([^\n]*)", "$1 user@mail.ru +7 912 123 45 67").alias("text"))
    return dt.linked_medium(dt.evidence(dt.candidates(docs))).select("doc_id", "type", "masked")


@query("evidence_dedup", CORPUS + "select doc_id, type, masked, cast(1 as bigint) as n from ev where strength <> 'WEAK'")
def _(spark, sf_dir):
    # every card stands twice in its line
    twice = _corpus(spark, sf_dir).select("doc_id", F.regexp_replace("text", r"карта (\d{16})", "карта $1 и снова $1").alias("text"))
    return dt.confirmed(dt.evidence(dt.candidates(twice))).groupBy("doc_id", "type", "masked").agg(F.count("*").alias("n"))


def _next_digit(text: Column, pattern: str) -> Column:
    """Text with the next digit (0 after 9) for that of the pattern."""
    return F.regexp_replace(text, F.lit(pattern), F.translate(F.regexp_extract(text, pattern, 0), "0123456789", "1234567890"))


#: What spoils each kind of finding: its context, and its checksum (another check digit, whatever the number is), length or age.
NO_CONTEXT = [("СНИЛС", "номер"), ("ИНН", "код"), ("карта 4", "карта 5"), (r"БИК \d{9}", "БИК"), ("дата рождения", "дата"), ("паспорт серия", "запись"), ("<", "X"), ("info@", "user@"), ("почта:", "почта"), ("клиент: ", ""), ("тел:", "тел"), ("образец: ", ""), ("Иванов Иван Иванович", "Филиал Иванов")]
NO_CHECK = [(r"(?<=ИНН: \d{9})\d", _next_digit), (r"(карта \d{15})\d", "$1"), (r"12\.03\.\d{4}", "12.03.2090")]


def _spoilt(spark, sf_dir, how: list[tuple[str, str | Callable[[Column, str], Column]]]) -> DataFrame:
    text = F.col("text")
    for a, b in how:
        text = b(text, a) if callable(b) else F.regexp_replace(text, a, b)
    return dt.exclusions(dt.candidates(_corpus(spark, sf_dir).select("doc_id", text.alias("text")))).select("doc_id", "reason", "n")


@query(
    "rejected_without_context",
    CORPUS + """select doc_id, unnest(case v when 0 then ['snils_without_context'] when 1 then ['snils_checksum_fail'] when 2 then ['passport_without_context'] when 3 then ['inn_without_context']
    when 4 then ['email_without_person_context', 'phone_without_person_context'] when 5 then ['email_without_person_context'] when 6 then ['inn_without_context', 'passport_without_context']
    when 7 then ['account_without_bik'] when 8 then ['date_without_dob_context'] when 9 then ['passport_without_context'] when 10 then ['mrz_shape_fail'] else ['card_luhn_fail'] end) as reason, cast(1 as bigint) as n from corp
  union all select doc_id, 'organization_like_name', 1 from corp where name""",
)
def _(spark, sf_dir):
    return _spoilt(spark, sf_dir, NO_CONTEXT)


@query("rejected_by_checks", CORPUS + "select doc_id, reason, cast(1 as bigint) as n from ex union all select doc_id, case v when 2 then 'inn_checksum_fail' when 8 then 'dob_age_implausible' else 'card_length_fail' end, 1 from corp where v in (2, 8, 11)")
def _(spark, sf_dir):
    return _spoilt(spark, sf_dir, NO_CHECK)


@query("category_histogram", CORPUS + "select type, cast(count(*) as bigint) as n from ev where strength <> 'WEAK' group by type")
def _(spark, sf_dir):
    return _confirmed(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"))


@query("assessment", CORPUS + "select doc_id, cast(score as bigint) as score, cast(hits as bigint) as hits, level, cats, reason, split_part(split_part(cats, ';', 1), '=', 1) as strongest from found where hits > 0")
def _(spark, sf_dir):
    a = dt.assess(_confirmed(spark, sf_dir))
    cats = F.array_join(F.transform("detected_categories", lambda k: F.concat_ws("=", k, F.col("categories")[k].cast("string"))), "; ")
    return a.select("doc_id", *_long(score="overall_risk_score", hits="hit_count"), F.col("protection_level").alias("level"), cats.alias("cats"), F.col("short_reason").alias("reason"), F.col("strongest_category").alias("strongest"))


@query("detect_corpus", CORPUS + "select doc_id, hits > 0 as has_pd, cast(score as bigint) as score, cast(hits as bigint) as hits, level, coalesce((select string_agg(reason, ',' order by reason) from ex where ex.doc_id = found.doc_id), '') as excluded from found")
def _(spark, sf_dir):
    d = dt.detect(_corpus(spark, sf_dir))
    return d.select("doc_id", F.col("has_personal_data").alias("has_pd"), *_long(score="overall_risk_score", hits="hit_count"), F.col("protection_level").alias("level"), F.array_join(F.array_sort(F.map_keys("excluded_candidates")), ",").alias("excluded"))


@query("conversation_scan", "select conv_id * 1000 + turn as doc_id, false as has_pd, 'УЗ-0' as level from conversations")
def _(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return c.select("doc_id").join(dt.detect(c), "doc_id").select("doc_id", F.col("has_personal_data").alias("has_pd"), F.col("protection_level").alias("level"))


# ---------------------------------------------------------------- masks, levels, categories


@query(
    "mask_values",
    """select c_custkey, case c_custkey % 5 when 0 then left(cast(c_custkey + 100000 as varchar), 2) || '***' || right(cast(c_custkey + 100000 as varchar), 2) when 1 then 'a***@x' || c_custkey || '.ru' when 2 then '+7***' || right(cast(c_custkey + 79000000000 as varchar), 4) when 3 then left(c_name, 2) || '***' else '***' end as masked from customer""",
)
def _(spark, sf_dir):
    k = F.col("c_custkey")
    kind = F.element_at(F.array(*map(F.lit, ["inn", "email", "phone", "person_name", "address"])), (k % 5 + 1).cast("int"))
    value = F.when(k % 5 == 0, (k + 100000).cast("string")).when(k % 5 == 1, F.concat(F.lit("anna@x"), k, F.lit(".ru"))).when(k % 5 == 2, F.concat(F.lit("+"), k + 79000000000)).when(k % 5 == 3, F.col("c_name")).otherwise("abc")
    return _t(spark, sf_dir, "customer").select("c_custkey", rules.mask(kind, value).alias("masked"))


@query("value_hash", "select c_custkey, left(sha256(c_name), 16) as value_hash from customer")
def _(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", rules.value_hash(F.col("c_name")).alias("value_hash"))


@query("position_buckets", "select cast(o_orderkey // 25 as bigint) as bucket, cast(count(*) as bigint) as n from orders group by 1")
def _(spark, sf_dir):
    return _t(spark, sf_dir, "orders").groupBy(rules.position_bucket(F.col("o_orderkey")).alias("bucket")).agg(F.count("*").alias("n"))


LEVEL_SQL = """with c as (select o_orderkey as k, case when o_orderkey % 50 = 0 then 1 else 0 end as special, case when o_orderkey % 7 = 0 then 1 else 0 end as pay, o_orderkey % 130 as gov, o_orderkey % 201 as reg, case when o_orderkey % 3 = 0 then 1 else 0 end as oth from orders)
select k, case when special > 0 then 'УЗ-1' when pay > 0 or gov >= 100 then 'УЗ-2' when gov > 0 or reg >= 100 then 'УЗ-3' when reg + oth > 0 then 'УЗ-4' else 'УЗ-0' end as level, special + pay + gov + reg + oth > 0 as any_ from c"""


@query("protection_level", LEVEL_SQL)
def _(spark, sf_dir):
    k = F.col("o_orderkey")
    flag = lambda m: (k % m == 0).cast("long")
    counts = F.create_map(F.lit("Health"), flag(50), F.lit("bank card"), flag(7), F.lit("PASSPORT"), k % 130, F.lit("email"), k % 201, F.lit("mrz"), flag(3))
    level = levels.protection_level(counts)
    return _t(spark, sf_dir, "orders").select(k.alias("k"), level.alias("level"), (level != "УЗ-0").alias("any_"))


@query("taxonomy_join", CORPUS + "select coalesce(case when type in ('payment_card_number', 'bank_account') then 'payment' when type in ('passport', 'snils', 'inn') then 'government' when type = 'mrz' then null else 'regular' end, 'none') as class, cast(count(*) as bigint) as n from ev where strength <> 'WEAK' group by 1")
def _(spark, sf_dir):
    c = _confirmed(spark, sf_dir).select(levels.category_key(F.col("type")).alias("category"))
    return c.join(F.broadcast(levels.taxonomy(spark)), "category", "left").groupBy(F.coalesce("class", F.lit("none")).alias("class")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- whole-text patterns, ensemble, tagger


@query(
    "regex_candidates",
    CORPUS + """select doc_id, kind, cast(count(*) as bigint) as n, cast(max(conf) as double) as confidence from (
 select doc_id, 'passport' as kind, 0.75 + case when v in (9) then 0.05 else 0 end as conf from corp where v in (2, 6)
 union all select doc_id, 'snils', 0.8 from corp where v in (0, 1)
 union all select doc_id, 'inn', 0.8 from corp where v in (2, 3, 6)
 union all select doc_id, 'phone', 0.8 from corp where v = 4
 union all select doc_id, 'email', case when v = 4 or v = 5 then 0.9 else 0.85 end from corp where v in (4, 5)
 union all select doc_id, 'date_of_birth', 0.75 from corp where v = 8) group by 1, 2""",
)
def _(spark, sf_dir):
    e = dt.whole_text_entities(_corpus(spark, sf_dir))
    return e.groupBy("doc_id", F.col("type").alias("kind")).agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"))


@query(
    "ensemble_argmax",
    """with e as (select l_orderkey as doc, l_linenumber % 2 as t, cast(l_quantity as bigint) % 3 as s, l_discount as c, 'regex' as src, l_linenumber as o from lineitem union all select l_orderkey, l_linenumber % 2, cast(l_quantity as bigint) % 3, l_tax, 'rule', l_linenumber from lineitem),
r as (select *, row_number() over (partition by doc, t, s order by c desc, case src when 'regex' then 0 else 1 end, o) as n from e)
select doc as doc_id, cast(t as varchar) as type, cast(s as bigint) as a, c as confidence, src as source, cast(o as bigint) as o from r where n = 1""",
)
def _(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    part = lambda conf, src: li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ord"), (F.col("l_linenumber") % 2).cast("string").alias("type"), F.lit("x").alias("value"), F.col(conf).alias("confidence"), (F.col("l_quantity").cast("long") % 3).alias("start"), F.lit(0).alias("end"), F.lit(src).alias("source"))
    # repeated (order, line) pairs are given an order by all columns: the SQL side has the same ties only among equal rows
    m = dt.merge_entities(part("l_discount", "regex"), part("l_tax", "rule"))
    return m.select("doc_id", "type", *_long(a="start"), "confidence", "source", *_long(o="ord"))


@query("nlp_prefilter", CORPUS + "select doc_id, v in (0, 1, 2, 3, 4, 6, 8, 9) as run from corp")
def _(spark, sf_dir):
    c = _corpus(spark, sf_dir)
    hits = dt.whole_text_entities(c).where("type in ('snils', 'inn')")
    return dt.run_tagger(c, hits)


def _capitals(text: str) -> list[tuple[int, int, str]]:
    """A stand-in for a tagger: capitalised Cyrillic words in a row are persons, upper-case MRZ lines organizations, digits places."""
    import re

    spans = [(m.start(), m.end(), "PER") for m in re.finditer(r"[А-ЯЁ][а-яё]+(?: [А-ЯЁ][а-яё]+)+", text)]
    return spans + [(m.start(), m.end(), "ORG") for m in re.finditer(r"RUS[A-Z]+", text)] + [(m.start(), m.end(), "LOC") for m in re.finditer(r"\d{3,}", text)]


@query(
    "tagger_entities",
    CORPUS + "select doc_id, type, value, confidence, cast(a as bigint) as a from (select doc_id, 'person_name' as type, 'Иванов Иван Иванович' as value, cast(0.8 as double) as confidence, length(one) + 1 as a from corp where name union all select doc_id, 'organization', 'RUSIVANOV', cast(0.75 as double), 2 from corp where v = 10)",
)
def _(spark, sf_dir):
    return en.tagger_entities(_corpus(spark, sf_dir), _capitals).select("doc_id", "type", "value", "confidence", F.col("start").cast("long").alias("a"))


@query(
    "ensemble_detect",
    CORPUS + """, hits as (select doc_id from ev where strength <> 'WEAK'), rx as (select doc_id, case v when 0 then 1 when 1 then 1 when 2 then 2 when 3 then 1 when 4 then 2 when 5 then 1 when 6 then 2 when 8 then 1 else 0 end as n from corp)
select c.doc_id, cast(rx.n + (select count(*) from hits where hits.doc_id = c.doc_id) as bigint) as entity_count, case when v in (7, 11) then 'УЗ-2' when v in (0, 1, 2, 3, 6, 9) then 'УЗ-3' when v in (4, 5, 8, 10) then 'УЗ-4' else 'УЗ-0' end as level from corp c join rx using (doc_id)""",
)
def _(spark, sf_dir):
    return en.detect_all(_corpus(spark, sf_dir), config=dt.Config(whole_text=True)).select("doc_id", "entity_count", F.col("protection_level").alias("level"))


@query("fallback_assessment", CORPUS + "select doc_id, 40 as score, cast(case v when 2 then 2 when 4 then 2 when 6 then 2 else 1 end as bigint) as hits from corp where v in (0, 1, 2, 3, 4, 5, 6, 8)")
def _(spark, sf_dir):
    return en.fallback_assessment(dt.whole_text_entities(_corpus(spark, sf_dir))).select("doc_id", F.col("overall_risk_score").alias("score"), F.col("hit_count").alias("hits"))


# ---------------------------------------------------------------- chunks to files


@query(
    "page_chunks",
    """with p as (select o_custkey as path, row_number() over (partition by o_custkey order by o_orderkey) as page, repeat(o_orderpriority || ' ', cast(o_orderkey % 9 as integer)) as t from orders),
q as (select path, page, '[Страница ' || page || ']' || chr(10) || trim(t) as text from p where trim(t) <> ''),
b as (select *, coalesce(sum(length(text)) over (partition by path order by page rows between unbounded preceding and 1 preceding), 0) as base, cast(1 + ceil(greatest(0, length(text) - 40) / 35.0) as bigint) as n from q),
c as (select path, page, base, text, n, unnest(range(n)) as i from b)
select path, page, row_number() over (partition by path order by page, i) - 1 as chunk_id, cast(base + i * 35 as bigint) as chunk_start, cast(base + least(i * 35 + 40, length(text)) as bigint) as chunk_end, lead(i) over (partition by path order by page, i) is null as is_last from c""",
)
def _(spark, sf_dir):
    from pyspark.sql.window import Window

    o = _t(spark, sf_dir, "orders")
    page = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    pages = o.select(F.col("o_custkey").alias("path"), page.alias("page"), F.repeat(F.concat("o_orderpriority", F.lit(" ")), (F.col("o_orderkey") % 9).cast("int")).alias("text"))
    return scan.page_chunks(pages, 40, 5).select("path", F.col("page").cast("long").alias("page"), "chunk_id", "chunk_start", "chunk_end", "is_last")


@query("upload_checks", "select coalesce(problem, 'accepted') as problem, cast(count(*) as bigint) as n from (select case when k % 5 = 0 then 'unsupported' when k % 7 = 0 then 'empty' when k % 7 * 1000 > 5000 then 'too large' end as problem from (select c_custkey as k from customer)) group by 1")
def _(spark, sf_dir):
    k = F.col("c_custkey")
    up = _t(spark, sf_dir, "customer").select(F.concat(F.lit("/u/"), k, F.when(k % 5 == 0, ".exe").otherwise(".PNG")).alias("path"), (k % 7 * 1000).alias("size_bytes"))
    return scan.upload_checks(up, [".png", ".jpg"], 5000).groupBy(F.coalesce("problem", F.lit("accepted")).alias("problem")).agg(F.count("*").alias("n"))


@query("language_codes", "select c_custkey, replace(replace('rus, eng', ', ', '+'), ' ', '+') || '+' || lower(left(c_mktsegment, 3)) as codes from customer")
def _(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", tx.language_codes(F.concat(F.lit(" rus, eng "), F.lower(F.left("c_mktsegment", F.lit(3))))).alias("codes"))


@query("overlap_entity_dedup", "select l_orderkey as path, cast(l_linenumber % 2 as varchar) as type, 'value ' || cast(l_suppkey % 3 as varchar) as value, cast(l_partkey // 25 as bigint) as bucket from lineitem group by all")
def _(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    return mg.entity_keys(li.select(F.col("l_orderkey").alias("path"), (F.col("l_linenumber") % 2).cast("string").alias("type"), F.concat(F.lit(" Value  "), F.col("l_suppkey") % 3).alias("value"), F.col("l_partkey").alias("start")))


@query(
    "chunk_fold",
    """with c as (select user_id as path, event_id as chunk_id, length(event_type) as n, cast(value as bigint) % 100 as score, event_type as reason, case when event_id % 3 = 0 then '' else props end as snippet from events),
b as (select *, row_number() over (partition by path order by score desc, chunk_id desc) as r from c)
select path, cast(count(*) as bigint) as chunk_count, cast(sum(n) as bigint) as text_length, cast(max(score) as bigint) as score, max(case when r = 1 then reason end) as reason,
 coalesce((select snippet from c d where d.path = b.path and snippet <> '' order by chunk_id limit 1), '') as snippet from b group by path""",
)
def _(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    c = e.select(F.col("user_id").alias("path"), F.col("event_id").alias("chunk_id"), F.length("event_type").cast("long").alias("text_length"), (F.col("value").cast("long") % 100).alias("score"), F.lit("medium").alias("confidence"), F.col("event_type").alias("strongest"), F.col("event_type").alias("reason"), F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("props")).alias("snippet"), F.lit(0.0).alias("ms"))
    return mg.fold_chunks(c).select("path", "chunk_count", "text_length", "score", "reason", "snippet")


SQL["chunk_fold"] = SQL["chunk_fold"].replace("cast(value as bigint)", "cast(trunc(value) as bigint)")


@query(
    "partial_merge",
    """with p as (select o_custkey as path, o_orderkey as ord, (['success', 'empty', 'parse_error', 'critical_error', 'odd'])[o_orderkey % 5 + 1] as status, ([0, 1, 2, 3, 1])[o_orderkey % 5 + 1] as rk, o_orderkey % 4 as n, o_orderkey % 90 as score, o_orderpriority as reason from orders)
select path, arg_max(status, cast(rk as bigint) * 1000000000 - ord) as status, cast(sum(n) as bigint) as chunk_count, cast(max(score) as bigint) as score, arg_max(reason, cast(score as bigint) * 1000000000 - ord) as reason, string_agg('w' || ord, ',' order by ord) as warnings from p group by path""",
)
def _(spark, sf_dir):
    o, k = _t(spark, sf_dir, "orders"), F.col("o_orderkey")
    p = o.select(F.col("o_custkey").alias("path"), k.alias("ord"), F.element_at(F.array(*map(F.lit, ["success", "empty", "parse_error", "critical_error", "odd"])), (k % 5 + 1).cast("int")).alias("status"), (k % 4).alias("chunk_count"), F.lit(0).cast("long").alias("text_length"), F.lit(0.0).alias("ms"), (k % 90).alias("score"), F.lit("").alias("confidence"), F.lit("").alias("strongest"), F.col("o_orderpriority").alias("reason"), F.lit("").alias("snippet"), F.array(F.concat(F.lit("w"), k)).alias("warnings"))
    return mg.merge_partials(p).select("path", "status", "chunk_count", "score", "reason", F.array_join("warnings", ",").alias("warnings"))


def _results(spark, sf_dir):
    c = _corpus(spark, sf_dir).withColumn("status", F.lit("success"))
    return scan.scan_texts(c.select("path", "status", "text"), size=60, overlap=40)


@query("finalize", CORPUS + "select path, 'success' as status, cast(1 + greatest(0, ceil((length(text) - 600) / 580.0)) as bigint) as chunk_count, cast(score as bigint) as score, level, hits > 0 as has_pd, cats from found join corp using (doc_id, path, v)")
def _(spark, sf_dir):
    c = _corpus(spark, sf_dir).withColumn("status", F.lit("success"))
    r = scan.scan_texts(c.select("path", "status", "text"), size=600, overlap=20)
    cats = F.array_join(F.transform(F.array_sort(F.map_keys("categories")), lambda k: F.concat_ws("=", k, F.col("categories")[k].cast("string"))), "; ")
    return r.select("path", "status", "chunk_count", *_long(score="score"), F.col("protection_level").alias("level"), "has_pd", cats.alias("cats"))


@query("scan_overlapping_chunks")
def _(spark, sf_dir):
    return _results(spark, sf_dir).select("path", "status", "chunk_count", "entity_count", "has_pd", "protection_level")


def _plain_results(spark, sf_dir):
    c = _corpus(spark, sf_dir)
    d = dt.detect(c).join(c.select("doc_id", "path").hint("merge"), "doc_id")
    return d.select("path", F.lit("success").alias("status"), F.col("has_personal_data").alias("has_pd"), "categories", "protection_level", F.col("short_reason").alias("reason"), F.col("hit_count").alias("entity_count"), F.col("overall_risk_score").cast("double").alias("ms"))


@query("csv_report", CORPUS + """select path as "путь", regexp_replace(replace(cats, '; ', ', '), '=1', '', 'g') as "категории_пДн", cats as "количество_находок", level as "УЗ", upper((['txt', 'csv', 'html', 'unknown'])[doc_id % 4 + 1]) as "формат_файла", reason as "причина" from found where hits > 0""")
def _(spark, sf_dir):
    return rp.report_rows(_plain_results(spark, sf_dir))


@query("csv_report_all", CORPUS + """select path as "путь", regexp_replace(replace(cats, '; ', ', '), '=1', '', 'g') as "категории_пДн", case when cats = '' then '0' else cats end as "количество_находок", level as "УЗ", upper((['txt', 'csv', 'html', 'unknown'])[doc_id % 4 + 1]) as "формат_файла", reason as "причина" from found""")
def _(spark, sf_dir):
    return rp.report_rows(_plain_results(spark, sf_dir), findings_only=False)


@query("job_stats", CORPUS + "select cast(count(*) as bigint) as total, cast(count(*) as bigint) as success, cast(0 as bigint) as empty, cast(0 as bigint) as parse_error, cast(0 as bigint) as critical_error, cast(0 as bigint) as skipped, cast(count(*) filter (hits > 0) as bigint) as pd_found, cast(sum(hits) as bigint) as entities, sum(case when hits > 0 then score else 0 end) / greatest(1, count(*) filter (hits > 0)) as avg_pd_ms from found")
def _(spark, sf_dir):
    return rp.job_stats(_plain_results(spark, sf_dir))


@query("evaluation_by_category", CORPUS + "select type as category, cast(count(distinct doc_id) as bigint) as files, cast(count(*) as bigint) as entities from ev where strength <> 'WEAK' group by type")
def _(spark, sf_dir):
    return rp.by_category(_plain_results(spark, sf_dir))


@query("evaluation_by_format", CORPUS + "select upper((['txt', 'csv', 'html', 'unknown'])[doc_id % 4 + 1]) as format, cast(count(*) as bigint) as files, cast(count(*) filter (hits > 0) as bigint) as flagged from found group by 1")
def _(spark, sf_dir):
    return rp.by_format(_plain_results(spark, sf_dir))


@query("evaluation_topk", CORPUS + "select reason, cast(count(*) as bigint) as files from found group by reason order by files desc, min(path) limit 10")
def _(spark, sf_dir):
    return rp.top_reasons(_plain_results(spark, sf_dir))


@query("hash_dedup", "select min(doc_id) as doc_id, sha256(text) as file_hash from documents group by sha256(text)")
def _(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("file_hash"))
    return mg.unseen(d, order="doc_id")


@query("hash_dedup_seen", "select min(doc_id) as doc_id, sha256(text) as file_hash from documents group by sha256(text) having sha256(text) not in (select sha256(text) from documents where doc_id % 10 = 0)")
def _(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("file_hash"))
    return mg.unseen(d, d.where("doc_id % 10 = 0"), order="doc_id")


@query(
    "ttl_dedup",
    """with recursive s as (select distinct user_id, ts from events), w as (select user_id, min(ts) as ts from s group by user_id union all select user_id, nxt from (select w.user_id, (select min(s.ts) from s where s.user_id = w.user_id and s.ts >= w.ts + interval 7 day) as nxt from w) where nxt is not null)
select user_id, cast(count(*) as bigint) as fresh from w group by user_id""",
)
def _(spark, sf_dir):
    e = mg.within_ttl(_t(spark, sf_dir, "events").select("user_id", "ts"), "user_id", "ts")
    return e.where("fresh").groupBy("user_id").agg(F.countDistinct("ts").alias("fresh"))


@query("health_rollup", "select case when max(case when n_nationkey = 3 then 2 when n_nationkey % 7 = 0 then 1 else 0 end) = 2 then 'error' else 'degraded' end as status, cast(count(*) as bigint) as services from nation")
def _(spark, sf_dir):
    k = F.col("n_nationkey")
    return rp.health(_t(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.when(k == 3, "error").when(k % 7 == 0, "degraded").otherwise("ok").alias("status")))


@query("ocr_confidence", "select user_id, avg(value) as mean_confidence, string_agg(event_type, ' ' order by event_id) as text, cast(count(*) as bigint) as words from events where value >= 20 and value <> -1 group by user_id")
def _(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("ord"), F.col("event_type").alias("word"), F.col("value").alias("confidence"))
    return rp.ocr_summary(e, "user_id", 20.0)


@query("ocr_low_confidence", "select low, cast(count(*) as bigint) as n from (select avg(value) < 60 as low from events where value >= 20 and value <> -1 group by user_id) group by low")
def _(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("ord"), F.col("event_type").alias("word"), F.col("value").alias("confidence"))
    return rp.low_confidence(rp.ocr_summary(e, "user_id", 20.0)).groupBy(F.col("low_confidence").alias("low")).agg(F.count("*").alias("n"))


@query("skew_angle", "select user_id, coalesce(median(case when a > -45 and a < 45 then a end), 0.0) as skew from (select user_id, cast(event_id % 120 - 60 as double) as a from events) group by user_id")
def _(spark, sf_dir):
    return rp.skew_angle(_t(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 120 - 60).cast("double").alias("angle")), "user_id")


# ---------------------------------------------------------------- sources


@query(
    "pages_visible_text",
    r"""with a as (select page_id, regexp_replace(html, '(?is)<!--.*?-->', '', 'g') as h from pages), b as (select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '(?is)<script\b.*?</script>', '', 'g'), '(?is)<style\b.*?</style>', '', 'g'), '(?is)<noscript\b.*?</noscript>', '', 'g'), '(?is)<svg\b.*?</svg>', '', 'g'), '(?is)<footer\b.*?</footer>', '', 'g'), '(?is)<nav\b.*?</nav>', '', 'g') as h from a),
c as (select page_id, regexp_replace(h, '(?s)<[^>]*>', chr(10), 'g') as h from b)
select page_id, left(sha256(trim(regexp_replace(regexp_replace(h, '[ \t\r]*\n[ \t\r\n]*', chr(10), 'g'), '^\n+|\n+$', '', 'g'))), 16) as digest from c""",
)
def _(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", rules.value_hash(fl.visible_text(F.col("html"))).alias("digest"))


@query("rtf_text", r"select s_suppkey, 'Имя ' || s_name || ' адрес' as text from supplier")
def _(spark, sf_dir):
    raw = F.concat(F.lit(r"{\rtf1\ansi\b0 Имя "), "s_name", F.lit("\n}{\\par  адрес}"))
    return _t(spark, sf_dir, "supplier").select("s_suppkey", fl.rtf_text(raw).alias("text"))


@query("customer_rows_structured", "select c_custkey, 'ROW[' || c_custkey || '] | имя: ' || trim(c_name) || ' | сегмент: ' || c_mktsegment as line from customer")
def _(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", fl.render_row(F.col("c_custkey"), {"имя": F.col("c_name"), "пусто": F.lit("  "), "сегмент": F.col("c_mktsegment")}).alias("line"))


@query("mask_text")
def _(spark, sf_dir):
    return _corpus(spark, sf_dir).select("doc_id", scan.mask_text(F.col("text")).alias("masked"))


@query("file_messages", """select sha256(text) as key, '{"path":"/d/' || doc_id || '.txt","size_bytes":' || strlen(text) || ',"extension":".txt","file_hash":"' || sha256(text) || '"}' as value from documents""")
def _(spark, sf_dir):
    from .streaming.ingest import file_message

    d = _t(spark, sf_dir, "documents")
    return file_message(d.select(F.concat(F.lit("/d/"), "doc_id", F.lit(".txt")).alias("path"), F.octet_length("text").cast("long").alias("size_bytes"), F.lit(".txt").alias("extension"), F.sha2("text", 256).alias("file_hash")))


@query(
    "file_statuses",
    """with k as (select s_suppkey, s_suppkey % 7 as k, s_name as n from supplier)
  select s_suppkey, case when k in (2, 3) then 'empty' when k = 6 then 'parse_error' else 'success' end as status,
    case k when 0 then 'a.b[1]: ' || n when 5 then 'ROW[1] | имя: ' || n else '' end as text,
    case k when 1 then 'JSON decode error' when 4 then 'MP4 parsing is conservative and disabled by default' else '' end as warning,
    case when k = 6 then 'File too large for current worker limits' else '' end as error from k""",
)
def _(spark, sf_dir):
    # a good and a broken JSON file, a suffix without a reader, an empty text, a film, a table, a file over the limit
    k, n = (F.col("s_suppkey") % 7).cast("int") + 1, F.col("s_name")
    pick = lambda *x: F.element_at(F.array(*[v if not isinstance(v, str) else F.lit(v) for v in x]), k)
    text = pick("", "{", "x", "", "x", "", "x")
    text = F.when(k == 1, F.concat(F.lit('{"a": {"b": [null, "'), n, F.lit('"]}}'))).when(k == 6, F.concat(F.lit("имя,пусто\n"), n, F.lit(", \n"))).otherwise(text)
    files = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), F.when(k == 7, 600_000_000).otherwise(9).cast("long").alias("size_bytes"), pick(".json", ".json", ".xyz", ".txt", ".mp4", ".csv", ".txt").alias("extension"), F.encode(text, "UTF-8").alias("content"))
    first = lambda c: F.coalesce(F.try_element_at(c, F.lit(1)), F.lit(""))
    return fl.parse(files).select(F.col("path").cast("long").alias("s_suppkey"), "status", "text", F.regexp_replace(first("warnings"), "^(JSON decode error): .*", "$1").alias("warning"), first("errors").alias("error"))


@query(
    "supported_suffixes",
    """select '.' || s as suffix, cast(count(*) as bigint) as n from (select (['txt', 'BMP', 'bmp', 'tif', 'tiff', 'exe', 'Pdf', 'rst', 'tmp', 'gz'])[p_partkey % 10 + 1] as s from part)
  where lower(s) in ('txt', 'bmp', 'tiff', 'pdf', 'tmp') group by s""",
)
def _(spark, sf_dir):
    names = F.array(*map(F.lit, [".txt", ".BMP", ".bmp", ".tif", ".tiff", ".exe", ".Pdf", ".rst", ".tmp", ".gz"]))
    own = _t(spark, sf_dir, "part").select(F.element_at(names, (F.col("p_partkey") % 10 + 1).cast("int")).alias("suffix"))
    return own.where(F.lower("suffix").isin(fl.SUFFIXES)).groupBy("suffix").agg(F.count("*").alias("n"))


@query("json_flatten", """select '/e/' || event_id || '.json' as path, 'success' as status, array_to_string(list_transform(json_keys(props), lambda k: k || ': ' || json_extract_string(props, '$.' || k)), chr(10)) as text from events""")
def _(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", F.encode("props", "UTF-8").alias("content"))
    files = e.select(F.concat(F.lit("/e/"), "event_id", F.lit(".json")).alias("path"), F.octet_length("content").cast("long").alias("size_bytes"), F.lit(".json").alias("extension"), "content")
    return fl.parse(files).select("path", "status", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
