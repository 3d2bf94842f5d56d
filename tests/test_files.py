"""Sources, merging, reports, streams."""

import io
import json
import os
import zipfile

from pyspark.sql import functions as F

from veilscan.operators import merge as mg
from veilscan.operators import report as rp
from veilscan.plans.scan import scan_folder
from veilscan.sources import files as fl
from veilscan.streaming import ingest


def _docx():
    out = io.BytesIO()
    w = 'xmlns:w="http://w"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>Первый</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    return out.getvalue()


def _xlsx():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook><sheets><sheet name="S1"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>имя</t></si><si><t>Анна</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1"/></row><row><c r="A2" t="s"><v>1</v></c><c r="B2"><v>7</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def _pdf(pages, pack=True):
    """A PDF with a line of text on each page, its font mapped by a character map."""
    import zlib

    cmap = b"begincmap 1 beginbfrange <20> <7e> <0020> endbfrange 1 beginbfchar <80> <0418> endbfchar endcmap"
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (10 + 2 * k) for k in range(len(pages))) + b"] /Count %d /Resources << /Font << /F1 3 0 R >> >> >>" % len(pages)}
    objects[3] = b"<< /Type /Font /Subtype /Type1 /ToUnicode 4 0 R >>"
    objects[4] = b"<< /Length %d >>\nstream\n" % len(cmap) + cmap + b"\nendstream"
    for k, text in enumerate(pages):
        body = b"BT /F1 12 Tf 72 700 Td (" + text.encode("latin-1") + b") Tj 0 -14 Td [(se) -20 (cond) -300 (\\200x)] TJ ET" if text else b"0 0 m"
        raw = zlib.compress(body) if pack else body
        objects[10 + 2 * k] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (11 + 2 * k)
        objects[11 + 2 * k] = b"<< /Length %d%s >>\nstream\n" % (len(raw), b" /Filter /FlateDecode" if pack else b"") + raw + b"\nendstream"
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, x) for n, x in objects.items()) + b"trailer\n<< /Root 1 0 R >>\n%%EOF"


def test_pdf():
    for pack in (True, False):
        assert fl.read_pdf(_pdf(["one (1) two".replace("(", "\\(").replace(")", "\\)"), "", "x"], pack)) == ["one (1) two\nsecond \u0418x", "", "x\nsecond \u0418x"]
    assert fl.read_file(".pdf", 9, lambda: _pdf(["a", "", "b"]), fl.READERS)[1] == "[Страница 1]\na\nsecond Иx\n\n[Страница 3]\nb\nsecond Иx"


def test_metadata():
    assert fl.metadata(".pdf", _pdf(["a", "b"]).replace(b"/Root 1 0 R", b"/Root 1 0 R /Info << /Author (Anna) /Title <feff0418> >>")) == {"pages": "2", "author": "Anna", "title": "И", "subject": None, "creator": None}
    assert fl.metadata(".html", b"<title> A &amp; b</title>") == {"parser_mode": "visible_text_only", "title": "A & b"} and fl.metadata(".txt", "я".encode("cp1251") * 9)["encoding"] != "utf-8"
    assert fl.metadata(".docx", _docx())["author"] == "" and fl.metadata(".docx", b"no zip") == {} and fl.metadata(".xlsx", _xlsx())["sheets"] == "S1" and fl.metadata(".exe", b"") == {}
    assert fl.read_file(".png", 3, lambda: b"png", fl.READERS)[3] == [fl.NO_OCR] and fl.read_file(".png", 3, lambda: b"png", fl.READERS | {".png": lambda b: "said"})[:2] == ("success", "said")
    assert fl.read_file(".png", 3, lambda: b"png", fl.READERS | {".png": lambda b: 1 // 0})[3] == ["OCR error: ZeroDivisionError: integer division or modulo by zero"]


def test_session(spark):
    from veilscan.session import session

    assert session(spark_sql_ansi_enabled="true") is not None and spark.conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"


def test_charset():
    text = "Сегодня хорошая погода, и мы идём гулять по берегу реки. Паспорт выдан отделом внутренних дел."
    for name in ("utf-8", "utf-8-sig", "utf-16", "utf-16-le", "utf-16-be", "utf-32", "cp1251", "koi8-r", "cp866", "iso8859-5"):
        assert fl.read_text(text.encode(name)) == text, name
    assert fl.read_text("café naïve, 1 €".encode("cp1252")) == "café naïve, 1 €" and fl.charset(b"plain") == "utf-8"
    assert fl.charset(("я" * 40_000).encode()[: fl.SAMPLE + 1][: fl.SAMPLE]) == "utf-8" and fl.charset(("x" + "я" * 40_000).encode()) == "utf-8"


def test_xlsx_by_its_relations():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="http://r"><sheets><sheet name="Second" r:id="b"/><sheet name="First" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/sheet1.xml"/><Relationship Id="b" Target="/xl/worksheets/other.xml"/></Relationships>')
        z.writestr("xl/styles.xml", '<styleSheet><numFmts><numFmt numFmtId="170" formatCode="dd.mm.yyyy"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>день</t></is></c></row><row r="4"><c r="A4" s="1"><v>45292</v></c><c r="C4"><v>5</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/other.xml", '<worksheet><sheetData><row r="1"><c r="A1"><v>1.50</v></c><c r="B1"/></row><row r="2"><c r="A2" t="b"><v>1</v></c><c r="B2"><v>2</v></c></row></sheetData></worksheet>')
    assert fl.read_xlsx(out.getvalue()) == "SHEET[Second] ROW[1] | 1.5: True | col_2: 2\nSHEET[First] ROW[3] | день: 2024-01-01 00:00:00"


def test_readers():
    assert fl.read_csv("имя,n\nАнна, 1\n,\nБоб,2,9\n".encode()) == "ROW[1] | имя: Анна | n: 1\nROW[3] | имя: Боб | n: 2"
    assert fl.read_json(b'{"a":{"b":[1,null,"x"]},"c":true,"d":1.0}') == "a.b[0]: 1\na.b[2]: x\nc: True\nd: 1.0"
    assert fl.read_text("привет".encode("cp1251")) == "привет" and fl.read_text("a\r\nб\r".encode()) == "a\nб\n"
    assert fl.read_rtf(rb"{\rtf1\ansi\b0 Name \par {x}}") == "Name x"
    assert fl.read_html(b"<title>T</title><script>x</script><p>a &amp; b<!-- c --><footer>f</footer>") == "T\na & b"
    assert fl.read_docx(_docx()) == "Первый\n\na | b"
    assert fl.read_xlsx(_xlsx()) == "SHEET[S1] ROW[1] | имя: Анна | col_2: 7"


def test_scan_folder(spark, tmp_path):
    (tmp_path / "a.txt").write_text("СНИЛС: 112-233-445 95", encoding="utf-8")
    (tmp_path / "copy.txt").write_text("СНИЛС: 112-233-445 95", encoding="utf-8")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.json").write_text(json.dumps({"ИНН": "500100732259"}, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "sub" / "_kept.md").write_text("нет данных", encoding="utf-8")
    (tmp_path / ".hidden.txt").write_text("СНИЛС: 112-233-445 95", encoding="utf-8")
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    (tmp_path / "v.mp4").write_bytes(b"123")
    (tmp_path / "x.exe").write_bytes(b"123")
    (tmp_path / "x.bmp").write_bytes(b"bmp")
    (tmp_path / "none.txt").write_bytes(b"")
    (tmp_path / "bad.json").write_bytes(b"{")
    (tmp_path / "bad.pdf").write_bytes(b"not a pdf")
    (tmp_path / "scan.pdf").write_bytes(_pdf(["", ""]))
    (tmp_path / "text.pdf").write_bytes(_pdf(["cover", "INN 500100732259"]))
    got = {r["path"].rsplit("/", 1)[-1]: r for r in scan_folder(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.txt", "b.json", "_kept.md", "broken.docx", "v.mp4", "none.txt", "bad.json", "scan.pdf", "text.pdf", "bad.pdf", "x.bmp"}
    assert got["a.txt"]["has_pd"] and got["a.txt"]["protection_level"] == "УЗ-3" and got["b.json"]["has_pd"] and not got["_kept.md"]["has_pd"]
    # a reader's failure leaves a file without text and with a warning; only where nothing comes out at all the file is empty
    assert {n: (r["status"], r["chunk_count"], bool(r["warnings"])) for n, r in got.items() if n not in ("a.txt", "b.json")} == {
        "_kept.md": ("success", 1, False), "broken.docx": ("success", 1, True), "v.mp4": ("success", 1, True), "none.txt": ("empty", 0, False), "bad.json": ("success", 1, True),
        "scan.pdf": ("success", 1, True), "text.pdf": ("success", 2, False), "bad.pdf": ("empty", 0, False), "x.bmp": ("success", 1, True),
    }
    assert got["broken.docx"]["warnings"][0].startswith("DOCX parse error: ") and got["v.mp4"]["warnings"] == [fl.MP4_MESSAGE] and got["a.txt"]["ms"] > 0
    stored = {r["path"].rsplit("/", 1)[-1]: r for r in scan_folder(spark, f"file://{tmp_path}", store=True).collect()}
    assert set(stored) == set(got) - {"_kept.md", "none.txt"} and all(stored[n]["status"] == got[n]["status"] and stored[n]["categories"] == got[n]["categories"] for n in stored)
    seen = spark.createDataFrame([(r[0],) for r in fl.walk(spark, str(tmp_path), with_hash=True).where("path like '%a.txt'").select("file_hash").collect()], "file_hash string")
    assert "a.txt" not in {r["path"].rsplit("/", 1)[-1] for r in scan_folder(spark, str(tmp_path), seen).collect()}


def test_overlapping_chunks_count_once(spark):
    from veilscan.plans.scan import scan_texts

    text = "x" * 50 + "\nСНИЛС: 112-233-445 95\n" + "y" * 50
    df = spark.createDataFrame([("p", "success", text), ("q", "parse_error", ""), ("e", "success", "")], "path string, status string, text string")
    got = {r["path"]: r for r in scan_texts(df, size=90, overlap=60).collect()}
    assert got["p"]["categories"] == {"snils": 1} and got["p"]["chunk_count"] > 1 and got["q"]["status"] == "parse_error" and got["q"]["chunk_count"] == 0


def test_mask_text(spark):
    from veilscan.plans.scan import mask_text

    rows = [("СНИЛС 112-233-445 95 и user@mail.ru",), ("карта 4111111111111111, тел +7 912 123-45-67",), ("ничего",), (None,)]
    got = [r["m"] for r in spark.createDataFrame(rows, "text string").select(mask_text(F.col("text")).alias("m")).collect()]
    assert got == ["СНИЛС [snils] и [email]", "карта [card], тел [phone]", "ничего", None]


def test_entity_keys(spark):
    rows = [("f", "email", " User@Test.com ", 101), ("f", "email", "user@test.com", 119), ("f", "email", "user@test.com", 24), ("f", "email", "user@test.com", 25), ("f", "phone", "1", None)]
    keys = mg.entity_keys(spark.createDataFrame(rows, "path string, type string, value string, start int"))
    assert sorted(r["bucket"] for r in keys.where("type = 'email'").collect()) == [0, 1, 4] and keys.where("bucket is null").count() == 1


def test_ttl(spark):
    rows = [("h", f"2024-01-{1 + d:02d} 00:00:00") for d in (0, 6, 8, 14, 15, 16)] + [(None, "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "k string, t string").withColumn("ts", F.to_timestamp("t"))
    assert [r["t"][8:10] for r in mg.within_ttl(df, "k", "ts").where("fresh and k is not null").orderBy("ts").collect()] == ["01", "09", "16"]
    assert mg.within_ttl(df, "k", "ts").where("k is null and fresh").count() == 1


def test_report(spark, tmp_path):
    rows = [("a.txt", False, {}, "УЗ-0", None), ("b.txt", True, {"full_name": 1, "email": 2}, "УЗ-3", "r")]
    df = spark.createDataFrame(rows, "path string, has_pd boolean, categories map<string,bigint>, protection_level string, reason string")
    all_ = {r[0]: tuple(r) for r in rp.report_rows(df, False).collect()}
    assert all_["b.txt"] == ("b.txt", "email, full_name", "email=2; full_name=1", "УЗ-3", "TXT", "r") and all_["a.txt"][2] == "0"
    rp.write_csv(df, str(tmp_path / "csv"))
    assert [r["путь"] for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()] == ["b.txt"]


def test_stream(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    rows = [{"path": "/1", "extension": ".txt", "file_hash": "h1", "text": "СНИЛС: 112-233-445 95", "ts": "2024-01-01T00:00:00"}, {"path": "/2", "extension": ".txt", "file_hash": "h1", "text": "СНИЛС: 112-233-445 95", "ts": "2024-01-02T00:00:00"}, {"path": "/3", "extension": ".txt", "file_hash": None, "text": "ничего", "ts": "2024-01-02T00:00:00"}, {"path": None, "extension": ".txt", "file_hash": "h3", "text": "x", "ts": "2024-01-02T00:00:00"}]
    (src / "m.json").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows), encoding="utf-8")
    ingest.detect_stream(ingest.from_files(spark, str(src)), str(out), str(tmp_path / "cp")).awaitTermination(180)
    got = spark.read.parquet(str(out))
    assert got.count() == 2 and got.where("has_personal_data").select("file_hash").first()[0] == "h1"
    message = ingest.result_message(got).where("key = 'h1'").first()["value"]
    assert json.loads(message)["protection_level"] == "УЗ-3"


def test_stream_ttl(spark, tmp_path):
    """As the batch form: sightings on days 0, 6, 8, 14, 15, 16 in three batches; of these 0, 8 and 15 pass. Without a hash all do."""
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    row = lambda day, hash_, path: json.dumps({"path": path, "extension": ".txt", "file_hash": hash_, "text": "x", "ts": f"2024-01-{1 + day:02d}T00:00:00"})
    for k, days in enumerate(((0, 6), (8, 14), (15, 16))):
        (src / f"{k}.json").write_text("\n".join([row(d, "h", f"/{d}") for d in reversed(days)] + [row(d, None, "/same") for d in days]), encoding="utf-8")
        os.utime(src / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))  # the order of the batches
    stream = ingest.first_in_ttl(spark.readStream.schema(ingest.MESSAGE).option("maxFilesPerTrigger", 1).json(str(src)), delay="30 days")
    query = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    got = spark.read.parquet(str(out))
    assert sorted(r["path"] for r in got.where("file_hash = 'h'").collect()) == ["/0", "/15", "/8"] and got.where("file_hash is null").count() == 6
