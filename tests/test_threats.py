"""One positive and one near miss for each rule."""

import io
import json
import struct
import zipfile

import pytest
from cloakwork.functions import threats
from cloakwork.operators import screening
from pyspark.sql import functions as F


def packed(**parts):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for n, v in parts.items():
            z.writestr(n.replace("__", "/").replace("_DOT_", "."), v)
    return buf.getvalue()


PNG = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR"
CASES = [
    ("a.txt", b"plain text", ""), ("a.TXT", b"", ""), ("noext", b"x", 'File type "" is not allowed'), (".csv", b"x", 'File type "" is not allowed'), ("a.exe", b"x", 'File type ".exe" is not allowed'), ("a.exe.txt", b"x", 'Double extension detected (".exe.txt")'), ("a.b.txt", b"x", ""), (None, b"x", 'File type "" is not allowed'),
    ("a.txt", b"MZ", "File is a PE/EXE executable"), ("a.txt", b"\x7fELFx", "File is a ELF executable"), ("a.txt", b"\xca\xfe\xba\xbe", "File is a Java class / Mach-O fat"), ("a.txt", b"#!/bin/sh\n", "File is a script (shebang detected)"), ("a.txt", b"#! hello", ""), ("a.txt", b"#!x\npython", ""), ("a.txt", b"xxxxMZ This program", "Embedded executable detected inside file"), ("a.txt", b"xxxxMZ This Program", ""),
    ("a.doc", b"VBA Macro", "VBA macro detected in legacy Office file"), ("a.doc", b"VBA macro", ""), ("a.docx", b"PK\x03\x04", "Invalid Office document (corrupted ZIP structure)"), ("a.docx", packed(word__document_DOT_xml="<x/>"), ""), ("a.docx", packed(word__vbaProject_DOT_bin="x"), "VBA macro detected in Office document"), ("a.pptx", packed(x__oleObject1_DOT_bin="x"), "Embedded OLE object detected in Office document"),
    ("a.docx", packed(x_DOT_rels='<R TargetMode="External" Type="attachedTemplate"/>'), "External template injection detected in Office document"), ("a.docx", packed(x_DOT_rels='<R TargetMode="External" Type="hyperlink"/>'), ""), ("a.xlsx", packed(xl__sharedStrings_DOT_xml="<t>=dde(1)</t>"), "DDE command injection detected in spreadsheet"), ("a.docx", packed(word__document_DOT_xml="<instrText>dde</instrText>"), "DDE command injection detected in document"), ("a.docx", packed(word__document_DOT_xml="<t>dde</t>"), ""),
    ("a.pdf", b"x%PDF", "Invalid PDF (missing PDF header)"), ("a.pdf", b"%PDF /JavaScript", "JavaScript detected in PDF"), ("a.pdf", b"%PDF /JSX", ""), ("a.pdf", b"%PDF /OpenAction /JSX", "Auto-execution action with script detected in PDF"), ("a.pdf", b"%PDF /AA> /Launch", "Auto-execution action with script detected in PDF"), ("a.pdf", b"%PDF /Launch", "Launch action detected in PDF (potential command execution)"), ("a.pdf", b"%PDF /EmbeddedFile /Filespec", "Embedded file detected in PDF"), ("a.pdf", b"%PDF /EmbeddedFile", ""), ("a.pdf", b"%PDF /uri (JavaScript:x)", "Suspicious URI scheme detected in PDF"), ("a.pdf", b"%PDF \xff\xfe fine", ""),
    ("a.sql", b"select 1; Drop\n table x", 'Destructive SQL statement detected: "Drop\n table"'), ("a.sql", b"dropped table", ""), ("a.sql", b"copy x from program 'y'", 'Destructive SQL statement detected: "copy x from program"'), ("a.sql", b"/*!50000 x */", "MySQL conditional comment obfuscation detected in SQL"), ("a.sql", b"select 'it''s'", ""), ("a.sql", b"EXECUTE (x)", 'Destructive SQL statement detected: "EXECUTE ("'),
    ("a.csv", b'a,b\n1,"=HYPERLINK(""x"")"\n', 'Formula injection detected in CSV (row 2): "=HYPERLINK(""x"")"'), ("a.csv", b"=1+1,cmd", ""), ("a.csv", b"a, '@x|calc'", 'Formula injection detected in CSV (row 1): "@x|calc"'), ("a.csv", b"\n" * 2000 + b"=cmd|x", ""), ("a.csv", b"\n" * 1999 + b"=cmd|x", 'Formula injection detected in CSV (row 2000): "=cmd|x"'),
    ("a.json", b"[" * 51 + b"]" * 51, "JSON nesting depth exceeds limit (50)"), ("a.json", b"[" * 50 + b"]" * 50, ""), ("a.json", b'{"a": [{"__proto__": 1}]}', 'Prototype pollution key detected: "__proto__"'), ("a.json", b'{"a": "<SCRIPT"}', "Script injection detected in JSON value"), ("a.json", b'["x onload = y"]', "Script injection detected in JSON value"), ("a.json", b'{"onload=": 1}', ""), ("a.json", json.dumps("x" * 1048577).encode(), "JSON string value exceeds 1 MB"), ("a.json", json.dumps("x" * 1048576).encode(), ""), ("a.json", b"{not json", ""), ("a.json", b'{"a": "<script", "constructor": 1}', "Script injection detected in JSON value"),
    ("a.xml", b"<x><SCRIPT >", 'Embedded script/code detected in text file: "<SCRIPT"'), ("a.txt", b"<scripts", ""), ("a.txt", b"x <?php", 'Embedded script/code detected in text file: "<?php"'), ("a.txt", b"iex (", 'Embedded script/code detected in text file: "iex ("'), ("a.txt", b"TVqQ" + b"A" * 40, "Base64-encoded executable payload detected in text file"), ("a.txt", b"TVqQ" + b"A" * 39, ""), ("a.txt", b"see VBScript:x", "Suspicious URI scheme detected in text file"), ("a.txt", b"\xff\xfejavascript\xff:", "Suspicious URI scheme detected in text file"),
    ("a.png", b"x", "Invalid PNG file (bad magic bytes)"), ("a.png", PNG + struct.pack(">II", 10000, 10000), ""), ("a.png", PNG + struct.pack(">II", 10001, 10000), "Image bomb detected: 10001x10000 = 100,010,000 pixels (max 100,000,000)"), ("a.jpg", b"\xff\xd8\xff", ""), ("a.jpeg", b"\xff\xd8", "Invalid JPEG file (bad magic bytes)"), ("a.tif", b"II*\0", ""), ("a.tiff", b"II**", "Invalid TIFF file (bad magic bytes)"), ("a.bmp", b"BM", ""), ("a.bmp", b"MB", "Invalid BMP file (bad magic bytes)"), ("a.webp", b"RIFFxxxxWEBP", ""), ("a.webp", b"RIFFxxxxWEB", "Invalid WebP file (bad magic bytes)"), ("a.gif", b"GIF89a", ""), ("a.gif", b"GIF88a", "Invalid GIF file (bad magic bytes)"), ("a.heic", b"short", ""), ("a.heic", b"xxxxftypxxxx", ""), ("a.heic", b"xxxxftypXxxx"[::-1], "Invalid HEIC file (bad magic bytes)"),
    ("a.gif", b"GIF89a" + b"\0" * 94 + b"<%", 'Polyglot file detected: image contains embedded "<%" content'), ("a.gif", b"GIF89a" + b"\0" * 93 + b"<%", ""), ("a.gif", b"GIF89a" + b"\0" * 20_000 + b"<%", ""), ("a.gif", b"GIF89a JavaScript:", "Script injection detected in image metadata (EXIF)"), ("a.gif", b"GIF89a" + b"\0" * 65536 + b"javascript:", ""),
]


def test_rules(spark):
    df = spark.createDataFrame([(k, n, c) for k, (n, c, _) in enumerate(CASES)], "i int, filename string, content binary")
    got = {r.i: r for r in screening.screen(df).collect()}
    for k, (name, content, reason) in enumerate(CASES):
        assert (got[k].reason, got[k].is_safe) == (reason, reason == ""), (name, content[:60])


def test_size_and_nulls(spark):
    df = spark.createDataFrame([("a.txt", None), (None, None)], "filename string, content binary")
    assert [r.is_safe for r in screening.screen(df).orderBy("filename").collect()] == [False, True]
    big = spark.range(1).select(F.lit("a.txt").alias("filename"), F.repeat(F.lit("x"), (F.col("id") + 51 * 1024 * 1024).cast("int")).cast("binary").alias("content"))
    assert screening.screen(big).select("reason").first()[0] == "File too large (51 MB). Maximum is 50 MB"


@pytest.mark.parametrize(("name", "route", "scan"), [("a.b.CSV", ".csv", ".csv"), (".csv", ".csv", ""), ("x", "", ""), ("a.", ".", "."), ("d.x/y", ".x/y", ""), ("..a", ".a", "")])
def test_extensions(spark, name, route, scan):
    r = spark.createDataFrame([(name,)], "n string").select(threats.route_extension(F.col("n")), threats.scan_extension(F.col("n"))).first()
    assert tuple(r) == (route, scan)


def test_mimes(spark):
    cases = [(b"%PDF", "application/pdf"), (b"PK\x03\x04", "application/zip"), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "application/vnd.ms-excel"), (b"MM\0*", "image/tiff"), (b"RIFFxxxxWEBP", "image/webp"), (b"xxxxftypxxxx", "image/heic"), (b"xxxxftyp", ""), (b"", "")]
    df = spark.createDataFrame(cases, "c binary, m string")
    assert [tuple(r) for r in df.select(threats.mime(F.col("c")), "m").collect()] == [(m, m) for _, m in cases]


def test_queries_scan_whole_texts(spark, tmp_path):
    from cloakwork.plans import queries

    far = "plain words " * 500
    rows = [(6, far + "; DROP TABLE users; <script >"), (13, far), (20, "; DROP TABLE users; <script >" + far), (27, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sql = {r.doc_id: r.reason for r in queries.QUERIES["threat_sql"][0](spark, str(tmp_path)).collect()}
    script = {r.doc_id: r.reason for r in queries.QUERIES["threat_text_script"][0](spark, str(tmp_path)).collect()}
    assert sql == {6: 'Destructive SQL statement detected: "DROP TABLE"', 13: None, 20: 'Destructive SQL statement detected: "DROP TABLE"', 27: None}
    assert {k: v and v.split(":")[0] for k, v in script.items()} == {6: "Embedded script/code detected in text file", 13: None, 20: "Embedded script/code detected in text file", 27: None}
