"""Files to texts: the walk, the readers by suffix, the render forms of structured rows."""

from __future__ import annotations

import datetime
import hashlib
import html
import io
import json
import os
import re
import time
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .pdf import page_texts, properties

# Suffixes that a scan takes.
SUFFIXES = [".txt", ".log", ".md", ".pdf", ".doc", ".docx", ".rtf", ".xlsx", ".xlsm", ".csv", ".json", ".parquet", ".html", ".htm", ".mp4", ".jpg", ".jpeg", ".png", ".tiff", ".bmp", ".gif", ".tmp"]
LARGEST = 500_000_000
SAMPLE = 65_536
#: Suffixes whose texts are cut as they stream in; all others are one chunk, PDF pages are cut one by one.
STREAMED = (".txt", ".log", ".tmp", ".md", ".rst")
# Messages of files.
NOT_FOUND, TOO_LARGE, NO_PDF_TEXT = "File not found", "File too large for current worker limits", "PDF contains no extractable text"
NO_OCR = "OCR service connection failed"
MP4_MESSAGE = "MP4 parsing is conservative and disabled by default"


def walk(spark: SparkSession, root: str, suffixes: list[str] | None = None, most_mb: float | None = None, with_hash: bool = False) -> DataFrame:
    """path, size_bytes, extension, file_hash of the files below a local folder; hidden files and folders are left out. Paths are listed on the driver, contents are read by
    the executors; for other stores see binary_files()."""
    rows = []
    for folder, folders, names in os.walk(root):
        folders[:] = sorted(d for d in folders if not d.startswith("."))
        rows += [(os.path.join(folder, n),) for n in sorted(names) if not n.startswith(".")]

    def look(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            rows = []
            for p in b.path:
                size, digest = os.path.getsize(p), None
                if most_mb is not None and size > most_mb * 1024 * 1024:
                    continue  # not opened
                if with_hash:
                    h = hashlib.sha256()
                    with open(p, "rb") as f:
                        while block := f.read(1 << 20):
                            h.update(block)
                    digest = h.hexdigest()
                rows.append((p, size, os.path.splitext(p)[1].lower(), digest))
            yield pd.DataFrame(rows, columns=["path", "size_bytes", "extension", "file_hash"])

    schema = "path string, size_bytes long, extension string, file_hash string"
    listed = spark.createDataFrame(rows, "path string")
    own = set(suffixes or SUFFIXES)
    return listed.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(sorted(own))).mapInPandas(look, schema)


def binary_files(spark: SparkSession, root: str, suffixes: list[str] | None = None) -> DataFrame:
    """path, size_bytes, extension, file_hash, content by Spark's own reader, which takes any store (and leaves out empty files and names that begin with an underscore)."""
    own = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return own.where(ext.isin(suffixes or SUFFIXES)).select("path", F.col("length").alias("size_bytes"), ext.alias("extension"), F.sha2("content", 256).alias("file_hash"), "content")


# ---------------------------------------------------------------- expressions


def render_row(number: Column, columns: dict[str, Column]) -> Column:
    """ROW[i] | key: value | ..., without blank values."""
    parts = [F.when(F.trim(c.cast("string")) != "", F.concat(F.lit(f"{k}: "), F.trim(c.cast("string")))) for k, c in columns.items()]
    return F.concat_ws(" | ", F.concat(F.lit("ROW["), number.cast("string"), F.lit("]")), *parts)


def rtf_text(raw: Column) -> Column:
    """Without control words and braces, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"\\[a-zA-Z]+\d* ?", ""), r"[{}]", ""), r"\s+", " "))


def visible_text(page: Column) -> Column:
    """Text of well-formed html: without scripts, styles, head data, comments, footer and menus; a line for each piece of text. Entities stay (see read_html)."""
    t = F.regexp_replace(page, r"(?is)<!--.*?-->", "")
    for tag in ("script", "style", "noscript", "svg", "footer", "nav"):
        t = F.regexp_replace(t, rf"(?is)<{tag}\b.*?</{tag}>", "")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[ \t\r]*\n[ \t\r\n]*", "\n"), r"^\n+|\n+$", ""))


# ---------------------------------------------------------------- readers of bytes


_LOWER = "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё"


def charset(b: bytes) -> str:
    """The encoding of a text by its first SAMPLE bytes: marks, zeros of two-byte codes, well-formed UTF-8, else the code page that gives the likeliest Cyrillic text, if any does."""
    b = b[:SAMPLE]
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if b.startswith(mark):
            return name
    even, odd = b[::2], b[1::2]
    if len(b) > 3 and (b.count(0) > len(b) // 5 or b"\x04" in b and max(even.count(4), odd.count(4)) > len(b) // 4):
        return "utf-16-le" if sum(odd.count(x) for x in (0, 4)) > sum(even.count(x) for x in (0, 4)) else "utf-16-be"
    try:
        b.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError as e:
        if e.reason == "unexpected end of data" and e.start > len(b) - 4:  # the sample ends in a character
            return "utf-8"

    def likely(name: str) -> float:
        text, score = b.decode(name, "replace"), 0.0
        for x, y in zip(" " + text, text, strict=False):
            at = _LOWER.find(y)
            if at >= 0:
                score += 1.5 - at / 20
            elif "А" <= y <= "Я":
                score += -1.0 if x.islower() else 0.3
            elif y > "\x7f":
                score -= 1.0
            if x.isalpha() and y.isalpha() and (x < "\x7f") != (y < "\x7f"):  # two alphabets in a word
                score -= 2.0
        return score

    best = max(("cp1251", "koi8-r", "cp866", "iso8859-5", "mac-cyrillic"), key=likely)
    return best if likely(best) > 0.3 * sum(x > 127 for x in b) else "cp1252"


def _lines(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n")


def _decode(b: bytes) -> str:
    """As UTF-8, which all readers but that of plain texts take for granted."""
    return b.decode("utf-8", "replace")


def read_text(b: bytes) -> str:
    return _lines(b.decode(charset(b), "replace"))


def read_doc(b: bytes) -> str:
    return b.decode("cp1251", "ignore")


def read_rtf(b: bytes) -> str:
    t = re.sub(r"\\[a-zA-Z]+\d* ?", "", _lines(_decode(b)))
    return " ".join(re.sub(r"[{}]", "", t).split())


def read_csv(b: bytes) -> str:
    import csv

    rows, out = csv.DictReader(io.StringIO(_decode(b), newline="")), []
    for i, row in enumerate(rows, 1):
        parts = [f"{k.strip()}: {v.strip()}" for k, v in row.items() if k is not None and isinstance(v, str) and v.strip()]
        if parts:
            out.append(" | ".join([f"ROW[{i}]", *parts]))
    return "\n".join(out)


def read_json(b: bytes) -> str:
    out: list[str] = []
    todo: list[tuple[str, object]] = [("", json.loads(_decode(b)))]
    while todo:  # depth first, in the order of the file
        at, x = todo.pop()
        if isinstance(x, dict):
            todo += [(f"{at}.{k}" if at else str(k), v) for k, v in reversed(x.items())]
        elif isinstance(x, list):
            todo += [(f"{at}[{i}]", v) for i, v in reversed(list(enumerate(x)))]
        elif x is not None:
            out.append(f"{at}: {x}")
    return "\n".join(out)


def read_parquet(b: bytes) -> str:
    table = pd.read_parquet(io.BytesIO(b))
    rows = ((i, [f"{k}: {v}" for k, v in row.items() if str(v) != "nan"]) for i, row in table.iterrows())
    return "\n".join(" | ".join([f"ROW[{i}]", *parts]) for i, parts in rows if parts)


def read_html(b: bytes) -> str:
    t = re.sub(r"(?s)<!--.*?-->", "", _lines(_decode(b)))
    for tag in ("script", "style", "noscript", "svg", "footer", "nav"):
        t = re.sub(rf"(?is)<{tag}\b.*?</{tag}\s*>", "", t)
    t = re.sub(r"(?s)<[^>]*>", "\n", t)
    return "\n".join(x.strip() for x in html.unescape(t).split("\n") if x.strip())


def _xml(z: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    return ElementTree.fromstring(z.read(name)) if name in z.namelist() else None


def _is(node: ElementTree.Element, tag: str) -> bool:
    return node.tag.rpartition("}")[2] == tag


def _all(node: ElementTree.Element, tag: str) -> list[ElementTree.Element]:
    return [x for x in node.iter() if _is(x, tag)]


def read_docx(b: bytes) -> str:
    body = _xml(zipfile.ZipFile(io.BytesIO(b)), "word/document.xml")
    body = next(x for x in body if _is(x, "body"))
    said = lambda n: "".join(t.text or "" for t in _all(n, "t"))
    parts = [said(p) for p in body if _is(p, "p")]
    for table in (x for x in body if _is(x, "tbl")):
        cells = ((["\n".join(said(p) for p in _all(c, "p")).strip() for c in _all(row, "tc")]) for row in _all(table, "tr"))
        parts += [" | ".join(c for c in own if c) for own in cells]
    return "\n\n".join(p for p in parts if p.strip())


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show dates or times."""
    styles = _xml(z, "xl/styles.xml")
    if styles is None:
        return set()
    own = {int(f.get("numFmtId")): re.sub(r"\"[^\"]*\"|\[[^\]]*\]|\\\\.", "", f.get("formatCode") or "") for f in _all(styles, "numFmt")}
    fixed = {*range(14, 23), *range(45, 48)}
    xfs = next((x for x in styles if _is(x, "cellXfs")), [])
    return {k for k, x in enumerate(xfs) if (n := int(x.get("numFmtId") or 0)) in fixed or re.search("[dmyhs]", own.get(n, ""), re.I)}


def _number(v: str, date: bool, base: datetime.datetime) -> str:
    if not date:
        return str(float(v) if re.search("[.eE]", v) else int(v))
    n = float(v)
    if 0 <= n < 1:
        return str((base + datetime.timedelta(seconds=round(n * 86400))).time())
    return str(base + datetime.timedelta(days=int(n), seconds=round(n % 1 * 86400)) + datetime.timedelta(days=base.year == 1899 and n < 60))


def read_xlsx(b: bytes) -> str:
    z, out = zipfile.ZipFile(io.BytesIO(b)), []
    shared, book = _xml(z, "xl/sharedStrings.xml"), _xml(z, "xl/workbook.xml")
    strings = ["".join(t.text or "" for t in _all(s, "t")) for s in _all(shared, "si")] if shared is not None else []
    dates, since = _date_styles(z), datetime.datetime(1904, 1, 1) if any(p.get("date1904") in ("1", "true") for p in _all(book, "workbookPr")) else datetime.datetime(1899, 12, 30)
    targets = {r.get("Id"): r.get("Target") or "" for r in _all(rels, "Relationship")} if (rels := _xml(z, "xl/_rels/workbook.xml.rels")) is not None else {}
    for number, sheet in enumerate(_all(book, "sheet"), 1):
        at = next((v for k, v in sheet.attrib.items() if k.rpartition("}")[2] == "id"), None)
        file = targets.get(at, f"worksheets/sheet{number}.xml")
        page = _xml(z, file.lstrip("/") if file.startswith("/") else f"xl/{file}")
        head: list[str] = []
        begin = None
        for k, row in enumerate(_all(page, "row") if page is not None else []):
            cells: dict[int, str | None] = {}
            for j, c in enumerate(_all(row, "c")):
                letters = re.sub(r"\d", "", c.get("r") or "")
                place = sum((ord(x) - 64) * 26**p for p, x in enumerate(reversed(letters))) - 1 if letters else j
                v, kind = next((x.text for x in c if _is(x, "v")), None), c.get("t")
                if kind == "s" and v is not None:
                    v = strings[int(v)]
                elif kind == "inlineStr":
                    v = "".join(t.text or "" for t in _all(c, "t"))
                elif kind == "b" and v is not None:
                    v = str(v.strip() == "1")
                elif kind in (None, "n") and v:
                    v = _number(v, int(c.get("s") or 0) in dates, since)
                cells[place] = v
            n = int(row.get("r") or k + 1)
            if begin is None:
                begin = n
                head = [v.strip() if (v := cells.get(i)) is not None else f"col_{i + 1}" for i in range(max(cells, default=-1) + 1)]
            elif parts := [f"{head[i]}: {v.strip()}" for i in range(len(head)) if (v := cells.get(i)) is not None and v.strip()]:
                out.append(" | ".join([f"SHEET[{sheet.get('name')}] ROW[{n - begin}]", *parts]))
    return "\n".join(out)


def read_pdf(b: bytes) -> list[str]:
    """The texts of the pages."""
    return page_texts(b)


IMAGES = (".jpg", ".jpeg", ".png", ".tiff", ".bmp", ".gif")


def read_image(b: bytes) -> str:
    """Stands in for a reader of pictures, which is given by suffix."""
    raise ConnectionError(NO_OCR)


# ---------------------------------------------------------------- what files say of themselves


def _html_title(b: bytes) -> dict[str, str | None]:
    m = re.search(r"(?is)<title\b[^>]*>(.*?)</title\s*>", _decode(b))
    return {"parser_mode": "visible_text_only"} | ({"title": html.unescape(m[1]).strip()} if m else {})


def _docx_properties(b: bytes) -> dict[str, str | None]:
    core = _xml(zipfile.ZipFile(io.BytesIO(b)), "docProps/core.xml")
    own = {x.tag.rpartition("}")[2]: x.text for x in core} if core is not None else {}
    iso = lambda t: t.removesuffix("Z") + "+00:00" if t and t.endswith("Z") else t
    return {"author": own.get("creator") or "", "title": own.get("title") or "", "subject": own.get("subject") or "", "created": iso(own.get("created")), "modified": iso(own.get("modified"))}


def _sheets(b: bytes) -> dict[str, str | None]:
    book = _xml(zipfile.ZipFile(io.BytesIO(b)), "xl/workbook.xml")
    return {"parser_mode": "structured", "sheets": ", ".join(x.get("name") or "" for x in _all(book, "sheet"))}


#: Metadata by suffix.
METADATA: dict[str, Callable[[bytes], dict[str, str | None]]] = {
    **dict.fromkeys(STREAMED, lambda b: {"encoding": charset(b)}), **dict.fromkeys((".csv", ".json", ".parquet"), lambda b: {"parser_mode": "structured"}), ".html": _html_title, ".htm": _html_title,
    ".docx": _docx_properties, ".xlsx": _sheets, ".xlsm": _sheets, ".pdf": properties, ".mp4": lambda b: {"parser_mode": "conservative_mp4"}, **dict.fromkeys(IMAGES, lambda b: {"parser": "image_ocr", "size_bytes": str(len(b))}),
}


def metadata(extension: str, content: bytes) -> dict[str, str | None]:
    """What a file says of itself: encoding, title, author, pages; nothing of a broken one."""
    try:
        return METADATA[extension](content) if extension in METADATA else {}
    except Exception:  # what a broken file can raise is open
        return {}


READERS: dict[str, Callable[[bytes], str | list[str]]] = {
    **dict.fromkeys((".txt", ".log", ".tmp", ".md", ".rst"), read_text), ".csv": read_csv, ".json": read_json, ".parquet": read_parquet, ".doc": read_doc, ".rtf": read_rtf,
    ".html": read_html, ".htm": read_html, ".docx": read_docx, ".xlsx": read_xlsx, ".xlsm": read_xlsx, ".pdf": read_pdf, ".mp4": lambda b: "",
    **dict.fromkeys(IMAGES, read_image),
}
# The beginnings of messages of readers that do not end the file.
FAILED = {".csv": "CSV parse error", ".json": "JSON decode error", ".parquet": "Parquet parse error", ".xlsx": "XLSX parse error", ".xlsm": "XLSX parse error", ".docx": "DOCX parse error", ".doc": "DOC parse error", ".rtf": "RTF parse error", ".html": "HTML parse error", ".htm": "HTML parse error"}
PARSED = "path string, extension string, status string, text string, pages array<string>, warnings array<string>, errors array<string>, ms double, metadata map<string,string>"


def read_file(extension: str, size: int, content: Callable[[], bytes], readers: dict[str, Callable[[bytes], str | list[str]]], largest: int = LARGEST) -> tuple[str, str, list[str] | None, list[str], list[str]]:
    """(status, text, pages, warnings, errors) of one file. What a reader fails on leaves a successful file without text and with a warning; a PDF that cannot be read,
    a text that is empty, a suffix without a reader are empty; a PDF without text is a success with a warning."""
    if size > largest:
        return "parse_error", "", None, [], [TOO_LARGE]
    read = readers.get(extension)
    try:
        raw = content()
    except FileNotFoundError:
        return "parse_error", "", None, [], [NOT_FOUND]
    except OSError as e:
        return "critical_error", "", None, [], [str(e)[:200]]
    if read is None:
        return "empty", "", None, [], []
    try:
        got = read(raw)
    except Exception as e:  # what a broken file can raise is open
        # JSON that is well-formed but cannot be walked, and readers that are not known here, end the file
        ends = extension not in FAILED or extension == ".json" and not isinstance(e, json.JSONDecodeError)
        if extension in IMAGES:
            return "success", "", None, [NO_OCR if isinstance(e, ConnectionError) else f"OCR error: {type(e).__name__}: {e}"], []
        return ("empty", "", None, [], []) if ends else ("success", "", None, [f"{FAILED[extension]}: {e}"], [])
    if isinstance(got, list):
        return "success", "\n\n".join(f"[Страница {k}]\n{t}" for k, t in enumerate(got, 1) if t), got, [] if any(t.strip() for t in got) else [NO_PDF_TEXT], []
    if extension == ".mp4" and not got:
        return "success", "", None, [MP4_MESSAGE], []
    return ("empty" if extension in STREAMED and not got else "success"), got, None, [], []


def parse(files: DataFrame, extra: dict[str, Callable[[bytes], str | list[str]]] | None = None, largest: int = LARGEST) -> DataFrame:
    """path, extension, status, text, pages (of readers that give a list), warnings, errors, ms (spent on reading), metadata of files (path, size_bytes, extension, and content, or else
    a path that executors can open). extra: readers by suffix - OCR for images - or replacements. See read_file()."""
    readers = READERS | (extra or {})
    has = "content" in files.columns

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            rows = []
            for f in b.itertuples():

                def content(f=f) -> bytes:
                    if has:
                        return f.content
                    with open(f.path, "rb") as x:
                        return x.read()

                at = time.perf_counter()
                got = read_file(f.extension, f.size_bytes, content, readers, largest)
                said = metadata(f.extension, content()) if not got[4] else {}
                rows.append((*got, round((time.perf_counter() - at) * 1000, 3), said))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            yield pd.DataFrame({"path": b.path, "extension": b.extension} | {c: list(v) for c, v in zip(("status", "text", "pages", "warnings", "errors", "ms", "metadata"), cols, strict=True)})

    cols = ["path", "size_bytes", "extension"] + ["content"] * has
    return files.select(*cols).mapInPandas(run, PARSED)
