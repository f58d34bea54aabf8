"""Formats, files, ingest, catalog, streaming and the SQL function."""

import csv
import io
import json
import zipfile

import pandas as pd
import pytest
from cloakwork import streaming
from cloakwork.functions import spans, sql
from cloakwork.operators import catalog, detection, geometry
from cloakwork.sources import files, formats
from pyspark.sql import functions as F

from . import model

MAIL = "a@b.org"


def packed(parts):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for n, v in parts.items():
            z.writestr(n, v)
    return buf.getvalue()


def docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:mc="urn:mc" mc:Ignorable="w14" xmlns:w14="urn:w14"'
    body = f"<w:p><w:r><w:rPr><w:b/></w:rPr><w:t>Mail a@</w:t></w:r><w:r><w:t>b.org</w:t><w:tab/><w:t>x</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>{MAIL}</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>clean</w:t></w:r></w:p>"
    return packed({"[Content_Types].xml": "<x/>", "word/document.xml": f"<?xml version='1.0'?><w:document {w}><w:body>{body}</w:body></w:document>"})


def xlsx():
    m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f'<worksheet {m}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><v>5</v></c><c r="C1" t="inlineStr"><is><t>{MAIL}</t></is></c><c r="D1"><f>A1&amp;"x"</f><v>1</v></c></row></sheetData></worksheet>'
    return packed({"xl/sharedStrings.xml": f"<sst {m}><si><t>name</t></si></sst>", "xl/worksheets/sheet1.xml": sheet})


def pptx():
    a = 'xmlns:a="urn:a" xmlns:p="urn:p"'
    p = f"<a:p><a:r><a:t>to a@</a:t></a:r><a:r><a:t>b.org</a:t></a:r></a:p>"  # noqa: F541
    table = f"<p:graphicFrame><a:graphic><a:graphicData><a:tbl><a:tr><a:tc><a:txBody><a:p><a:r><a:t>{MAIL}</a:t></a:r></a:p></a:txBody></a:tc></a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame>"
    return packed({"ppt/slides/slide1.xml": f"<p:sld {a}><p:cSld><p:spTree><p:sp><p:txBody>{p}</p:txBody></p:sp>{table}</p:spTree></p:cSld></p:sld>"})


def test_office_units():
    assert [t for _, t in formats.HANDLERS["docx"][0](docx())] == ["Mail a@b.org\tx", "clean", MAIL]
    assert formats.xlsx_texts(xlsx()) == [("sheet1!A1", "name"), ("sheet1!C1", MAIL), ("sheet1!D1", '=A1&"x"')]
    assert [t for _, t in formats.HANDLERS["pptx"][0](pptx())] == ["to a@b.org", MAIL]
    new = formats.HANDLERS["docx"][1](docx(), ["NEW ", "clean", "Z"])
    assert [t for _, t in formats.HANDLERS["docx"][0](new)] == ["NEW ", "clean", "Z"]
    xml = zipfile.ZipFile(io.BytesIO(new)).read("word/document.xml").decode()
    assert "<w:b/>" in xml and 'xmlns:w14="urn:w14"' in xml and 'xml:space="preserve"' in xml


def test_round_trips():
    data = b'a,"b ""q"", c"\r\n"two\nlines",\xff\r\nshort\r\n'
    assert list(csv.reader(io.StringIO(formats.csv_with(data, [t for _, t in formats.csv_texts(data)]).decode()))) == [["a", 'b "q", c'], ["two\nlines", "�"], ["short"]]
    tree = {"k": ["x", {"y": "é", "n": 1.5, "b": None}], "z": "w"}
    raw = json.dumps(tree).encode()
    assert [a for a, _ in formats.json_texts(raw)] == ['["k", 0]', '["k", 1, "y"]', '["z"]']
    assert formats.json_with(raw, ["x", "é", "w"]) == json.dumps(tree, indent=2, ensure_ascii=False).encode()
    assert formats.json_with(b'"root"', ["new"]) == b'"new"' and formats.json_with(b"[1]", []) == b"[\n  1\n]"
    stmt = b"SELECT 'it''s', \"q\" -- 'no'\n/* 'no' */ FROM t;\n\n DELETE 'x"
    assert [t for _, t in formats.sql_texts(stmt)] == ["it''s", "q"]
    assert formats.sql_with(stmt, ["A'", "B"]) == b"SELECT 'A'', \"B\" -- 'no'\n/* 'no' */ FROM t;\nDELETE 'x"
    assert formats.sql_with(b"SELECT 1;\n\n", []) == b"SELECT 1;\n\n"


@pytest.mark.parametrize("ext", [".pdf", ".png", ".doc", ".xls", ".zip", ""])
def test_unsupported(ext):
    with pytest.raises(formats.Unsupported):
        formats.handler(ext)


def test_sanitize_files(spark):
    rows = [("t.txt", f"mail {MAIL} \xff".encode("latin-1")), ("x.xml", f"<a>{MAIL}</a>".encode()), ("c.csv", f"h,{MAIL}\r\n".encode()), ("j.json", json.dumps([MAIL, 1]).encode()), ("bad.json", b"{"), ("d.docx", docx()), ("s.xlsx", xlsx()), ("p.pptx", pptx()), ("q.sql", f"x '{MAIL}';".encode()), ("i.png", b"x"), ("empty.csv", b""), ("bad.docx", b"x")]
    df = files.as_files(spark.createDataFrame(rows, "filename string, content binary"))
    names = {r.file_id: r.filename for r in df.collect()}
    got = {names[r.file_id]: r for r in files.sanitize_files(df).collect()}
    assert got["t.txt"].sanitized.decode() == "mail [REDACTED] �" and got["t.txt"].pii_count == 1
    assert got["x.xml"].sanitized == b"<a>[REDACTED]</a>" and got["c.csv"].sanitized == b"h,[REDACTED]\r\n"
    assert json.loads(got["j.json"].sanitized) == ["[REDACTED]", 1] and got["q.sql"].sanitized == b"x '[REDACTED]';"
    assert [t for _, t in formats.HANDLERS["docx"][0](bytes(got["d.docx"].sanitized))] == ["Mail [REDACTED]\tx", "clean", "[REDACTED]"]
    assert formats.xlsx_texts(bytes(got["s.xlsx"].sanitized))[1] == ("sheet1!C1", "[REDACTED]") and got["p.pptx"].pii_count == 2
    assert got["bad.json"].problem and got["bad.json"].sanitized is None and got["bad.docx"].problem and "i.png" not in got and got["empty.csv"].sanitized == b""
    problems = {r.filename: r.problem for r in files.route(df).collect()}
    assert problems["i.png"] == ".png needs an OCR engine" and problems["t.txt"] is None
    with pytest.raises(ValueError):
        files.sanitize_files(df, "other")


def test_ingest(spark, tmp_path):
    (tmp_path / "a.txt").write_text(f"Name: Asha Rao\n{MAIL}")
    (tmp_path / "b.txt").write_text("<script >")
    got = files.ingest(files.read_files(spark, str(tmp_path)), "mask", "u1", "0123456789abcdef")
    assert [r.reason for r in got["rejected"].collect()] == ['Embedded script/code detected in text file: "<script"']
    row = got["files"].first()
    assert (row.original_filename, row.pii_count, row.mode) == ("a.txt", 2, "mask") and row.sanitized_path
    assert bytes(files.decrypted(got["raw"], "0123456789abcdef").first().content).decode().endswith(MAIL)
    assert bytes(got["sanitized"].first().sanitized).decode() == "Name: A*******\na@b.org"
    assert sorted(r.action for r in got["audit"].collect()) == ["file_rejected", "pii_detection", "upload"]


def test_new_files_stream(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    for k in range(2):
        (src / f"{k}.txt").write_text(f"{k} {MAIL}")
        streaming.sanitize_new_files(spark, str(src), out, str(tmp_path / "state"))
        assert sorted(bytes(r.sanitized).decode() for r in spark.read.parquet(out).collect()) == [f"{j} [REDACTED]" for j in range(k + 1)]


def test_sql_function(spark):
    sql.register(spark)
    rows = spark.createDataFrame([(k, t) for k, t in enumerate([*model.EDGES, model.GOLDEN, None])], "k int, t string")
    got = spark.sql("SELECT x.k, s.* FROM {rows} x, LATERAL detect_spans(x.t) s", rows=rows).collect()
    for k, (t, want) in enumerate({**model.EDGES, model.GOLDEN: model.detect(model.GOLDEN)}.items()):
        assert [tuple(r)[1:] for r in got if r.k == k] == want, t


def test_model_pass(spark):
    """A model's spans count for short texts only."""
    df = spark.createDataFrame([(1, "Meet Zed\nnow"), (2, "Zed " + "x" * 2001), (3, None)], "i int, text string")
    kind = spans.SPANS

    def zed(text):
        at = F.instr(text, "Zed") - 1
        return F.when(at >= 0, F.array(spans.span("NAME", at, at + 6, 0.9, 500))).otherwise(F.array().cast(kind))

    got = {r.i: [tuple(s)[:3] for s in r.spans] for r in detection.with_routed_spans(df, zed).collect()}
    assert got == {1: [("NAME", 5, 8)], 2: [], 3: []}


def test_catalog(spark):
    users = spark.createDataFrame([("1", "ann", "a@x", "admin"), ("2", "bob", "b@x", "user"), ("3", "bob", "c@x", "user")], "id string, username string, email string, role string")
    rows = spark.createDataFrame([("f1", "A.csv", "1", 2), ("f2", "b.csv", "2", 3), ("f3", "c.txt", "3", 5)], "id string, original_filename string, upload_by string, pii_count int")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(catalog.visible_files(rows, users, "2", "user")) == ["f1", "f2"] and ids(catalog.visible_files(rows, users, "1", "admin")) == ["f1", "f2", "f3"]
    assert [(r.id, r.may_download, r.may_delete) for r in catalog.access(rows, users, "2", "user").orderBy("id").collect()] == [("f1", True, False), ("f2", True, True), ("f3", False, False)]
    assert ids(catalog.without(rows, "f3", "2", "user")) == ["f1", "f2", "f3"] and ids(catalog.without(rows, "f3", "3", "user")) == ["f1", "f2"]
    assert [tuple(r) for r in catalog.duplicates(users).collect()] == [("username", "bob", 2)] and ids(catalog.search(rows, "CSV")) == ["f1", "f2"]
    logs = spark.createDataFrame([("l1", "1", "view", "2024"), ("l2", "9", "view", "2025")], "id string, user_id string, action string, timestamp string")
    assert {r.who for r in catalog.named_logs(logs, users).collect()} == {"ann", "9"} and ids(catalog.newest(logs, "timestamp", 1)) == ["l2"]
    assert tuple(catalog.totals(rows, users, logs).first()) == (3, 10, 3, 2) and tuple(catalog.totals(rows.limit(0), users, logs).first())[:2] == (0, 0)
    assert catalog.is_taken(users, "zz", "b@x").count() == 1
    with pytest.raises(ValueError):
        catalog.log_rows(users.withColumnRenamed("id", "user_id"), "other", F.lit("x"))
    assert catalog.log_rows(users.withColumnRenamed("id", "user_id"), "login", F.lit(None)).count() == 3


def test_config():
    got = geometry.ocr_config({"dpi": 72, "model": {"x": 1}, "preprocessing": None, "own": 2})
    assert got["dpi"] == 72 and got["model"] == {"use_angle_cls": True, "x": 1} and got["preprocessing"] is None and got["own"] == 2 and got["concurrency"] == 4


def test_windows(spark):
    def plain(t):
        out, pos = [], 0
        while pos < len(t):
            end = min(pos + 3500, len(t))
            if end < len(t) and (b := t.rfind(" ", pos + 2800, end)) > pos:
                end = b + 1
            out.append((pos, end))
            if end == len(t):
                break
            pos = max(pos + 1, end - 700)
        return out

    texts = ["", "x", "x" * 3500, "x" * 3501, "ab " * 4000, "x" * 9000 + " " + "y" * 900, "a" * 2799 + " " + "b" * 3000, "é " * 3000]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", geometry.windows(F.col("t")).alias("w"))
    assert [[tuple(x) for x in r.w] for r in df.orderBy("k").collect()] == [plain(t) for t in texts]


def test_batches(spark):
    lengths = [5, 0, 30, 3, 1, 50, 1]
    got = spark.createDataFrame([(lengths,)], "l array<int>").select(geometry.greedy_batches(F.col("l"), 40)).first()[0]
    out, size, batch = [], 0, 0
    for n in lengths:
        if size and size + n + 3 > 40:
            batch, size = batch + 1, 0
        size += n + 3
        out.append(batch)
    assert got == out


def test_batched_rewriting_equals_unit_by_unit(spark):
    texts = ["name:", "Asha Rao", MAIL, " ", "x " * 30, "DOB:", "10.0.0.1 customer Foo Bar"]
    units = spark.createDataFrame([(f"f{k % 2}", k, t) for k, t in enumerate(texts * 2)], "file_id string, seq long, text string")
    batched = {(r.file_id, r.seq): r.text for r in detection.sanitize_batches(units, "mask", 40).collect()}
    single = {(r.file_id, r.seq): r.clean for r in detection.sanitize(units, "mask").collect() if r.text.strip()}
    assert batched == single


def test_stubs_say_what_is_missing():
    for f in (formats.read_pdf, formats.read_image, formats.preprocess_image, formats.analyse_layout, formats.convert_image):
        with pytest.raises(formats.Unsupported, match="not available"):
            f(b"")


def test_postprocess(spark):
    df = pd.DataFrame({"t": ["ﬁx \t\n Ａ1  ", None, ""]})
    assert [r[0] for r in spark.createDataFrame(df, "t string").select(geometry.postprocess(F.col("t"))).collect()] == ["fix\n A1", None, ""]


def test_files_without_owner_stay(spark):
    from cloakwork.operators import catalog

    files = spark.createDataFrame([("1", None), ("2", "u")], "id string, upload_by string")
    role = sorted(catalog.ROLES)
    other = next(r for r in role if r != "admin")
    assert [r.id for r in catalog.without(files, "1", "u", other).collect()] == ["1", "2"]
    assert [r.id for r in catalog.without(files, "2", "u", other).collect()] == ["1"]
