"""Text expressions: normal form, lines, chunks, counts, guesses. All are built-in column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where a line ends; the same places as Python's splitlines().
LINE_END = r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"
NBSP = "\u00a0"
# Repairs of recognised text, in this order.
OCR_REPAIRS = ((r"(?U)(\d)\s+(?=\d)", "$1"), (r"(?U)([А-ЯЁ])\s+(?=[А-ЯЁ])", "$1"), (r"(?<=\d)O(?=\d)", "0"), (r"(?<=\d)[Il](?=\d)", "1"), (r"(?U)\s+", " "))


def normalize(text: Column) -> Column:
    """Null to empty, no-break spaces to spaces, runs of blanks to one space."""
    return F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), NBSP, " "), "[ \t]+", " ")


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def once(x: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(x), for which x is worked out once, however often fn names it: Spark would copy it to each place inside a higher-order function."""
    return F.transform(F.array(x), fn)[0]


def before(sizes: Column) -> Column:
    """For each of an array's numbers the sum of those before it. Sums are gathered in runs of 256, so the work stays linear."""
    kind = "struct<total:int,run:array<int>,done:array<array<int>>>"
    none = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("run"), F.array().cast("array<array<int>>").alias("done")).cast(kind)

    def step(acc: Column, n: Column) -> Column:
        full, one = F.size(acc["run"]) >= 256, F.array(acc["total"])
        run = F.when(full, one).otherwise(F.concat(acc["run"], one))
        done = F.when(full, F.concat(acc["done"], F.array(acc["run"]))).otherwise(acc["done"])
        return F.struct((acc["total"] + n).alias("total"), run.alias("run"), done.alias("done")).cast(kind)

    return F.aggregate(sizes, none, step, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["run"]))))


def lines(text: Column) -> Column:
    """array<struct<idx, text, offset>> of the non-blank lines: raw line number, stripped text, start of the raw line with one character for each line end."""
    placed = once(F.split(text, LINE_END), lambda parts: F.zip_with(parts, before(F.transform(parts, lambda x: F.length(x) + 1)), lambda t, o: F.struct(t.alias("t"), o.alias("o"))))
    all_ = F.transform(placed, lambda x, i: F.struct(i.alias("idx"), strip(x["t"]).alias("text"), x["o"].alias("offset")))
    return F.filter(all_, lambda x: x["text"] != "")


def contains_any(low: Column, words: list[str]) -> Column:
    """Whether lower-cased text holds one of the words, as a substring."""
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return out


def structured(line: Column) -> Column:
    """A line that looks like a field: a colon or an equals sign (tabs are gone after normalize)."""
    return line.contains(":") | line.contains("=")


def digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def matches(text: Column, pattern: str) -> Column:
    """array<struct<value, start, end>> of all matches, starts in code points. The gaps between the matches give the places."""
    p = f"(?U){pattern}"
    pairs = F.zip_with(F.regexp_extract_all(text, F.lit(p), F.lit(0)), F.split(text, p, -1), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g")))
    pairs = F.filter(pairs, lambda x: x["m"].isNotNull())  # one gap more than matches

    def item(x: Column, at: Column) -> Column:
        return F.struct(x["m"].alias("value"), (at + x["g"]).alias("start"), (at + x["g"] + F.length(x["m"])).alias("end"))

    none = F.array().cast("array<struct<value:string,start:int,end:int>>")
    return F.when(text.rlike(p), once(pairs, lambda x: F.zip_with(x, before(F.transform(x, lambda y: y["g"] + F.length(y["m"]))), item))).otherwise(none)


def chunks(text: Column, size: int, overlap: int) -> Column:
    """Overlapping windows array<struct<chunk_id, text, start, end, is_last>>: the last one ends with the text; an empty text is one empty chunk."""
    if size <= 0 or overlap < 0:
        raise ValueError("the size must be positive, the overlap not negative")
    step = size - min(overlap, size - 1)
    n, t = F.length(text), text
    count = F.lit(1) + F.ceil(F.greatest(F.lit(0), n - size) / F.lit(step)).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.alias("chunk_id"), F.substring(t, i * step + 1, F.lit(size)).alias("text"), (i * step).alias("start"), F.least(i * step + size, n).alias("end"), (i == count - 1).alias("is_last")))


def stream_chunks(text: Column, size: int, overlap: int) -> Column:
    """As a reader of a text stream cuts: whole windows while they last, then always what is left, be it only the overlap. None for empty text."""
    if size <= 0 or overlap < 0:
        raise ValueError("the size must be positive, the overlap not negative")
    step = size - min(overlap, size - 1)
    n = F.length(text)
    full = F.when(n >= size, F.floor((n - size) / F.lit(step)).cast("int") + 1).otherwise(F.lit(0))
    tail = (full * step < n).cast("int")
    at = F.when(full + tail > 0, F.sequence(F.lit(0), full + tail - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(i.alias("chunk_id"), F.substring(text, i * step + 1, F.lit(size)).alias("text"), (i * step).alias("start"), F.least(i * step + size, n).alias("end"), (i >= full).alias("is_last")))


def snippet(text: Column, start: Column, end: Column, window: int = 80) -> Column:
    """The match with so many characters around it."""
    a = F.greatest(F.lit(0), start - window)
    return F.substring(text, a + 1, F.least(F.length(text), end + window) - a)


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0)))


def guess_language(text: Column) -> Column:
    """rus, eng or mixed by the share of Cyrillic among Cyrillic and ASCII letters; null without letters."""
    def guess(x: Column) -> Column:
        share = x["c"] / (x["c"] + x["a"])
        return F.when(x["c"] + x["a"] > 0, F.when(share > 0.7, "rus").when(share < 0.3, "eng").otherwise("mixed"))

    # runs of other characters go at a time
    c, a = (F.length(F.regexp_replace(text, f"[^{own}]+", "")) for own in ("Ѐ-ӿ", "A-Za-z"))
    return once(F.struct(c.alias("c"), a.alias("a")), guess)


def clean_ocr(text: Column) -> Column:
    """Joins spaced digits and capitals, turns letters between digits to digits, collapses white space."""
    t = F.coalesce(text, F.lit(""))
    for p, r in OCR_REPAIRS:
        t = F.regexp_replace(t, p, r)
    return F.trim(t)


def looks_like_name(text: Column) -> Column:
    """Two to four words of a capital and small letters."""
    return strip(text).rlike(r"(?U)^\p{Lu}\p{Ll}+(\s+\p{Lu}\p{Ll}+){1,3}$")


def file_format(path: Column) -> Column:
    """Upper-case suffix of a path's name, or UNKNOWN."""
    x = F.regexp_extract(F.regexp_extract(path, r"([^/]*)$", 1), r"^.+\.([^.]+)$", 1)
    return F.when(x == "", F.lit("UNKNOWN")).otherwise(F.upper(x))


def language_codes(codes: Column) -> Column:
    """A list with commas or spaces as one with plus signs."""
    return F.regexp_replace(F.trim(codes), r"[,\s]+", "+")
