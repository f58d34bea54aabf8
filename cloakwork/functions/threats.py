"""Threat rules over file bytes: each gives a reason, or null; the first reason in order is the verdict.

Rules are Columns over (name, content); only what a format hides inside a ZIP or a JSON tree needs Python, one Arrow batch at a time.
Bytes are searched as Latin-1 text where a pattern ignores case, so every byte is one character.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Limits.
MAX_FILE_BYTES = 50 * 1024 * 1024
MAX_JSON_DEPTH = 50
MAX_JSON_STRING = 1024 * 1024
MAX_PIXELS = 100_000_000
CSV_LINES = 2000
JSON_HEAD = 500_000
POLYGLOT_HEAD = 10_000
EXIF_HEAD = 65_536
SHEBANG_HEAD = 80

# Extensions.
EXTENSIONS = [".docx", ".pdf", ".xlsx", ".xls", ".doc", ".ppt", ".pptx", ".sql", ".csv", ".json", ".txt", ".xml", ".png", ".jpg", ".jpeg", ".tiff", ".tif", ".bmp", ".webp", ".gif", ".heic"]
DANGEROUS_INNER = [".exe", ".bat", ".cmd", ".com", ".msi", ".scr", ".pif", ".vbs", ".js", ".ps1", ".sh", ".dll", ".sys", ".cpl", ".hta", ".wsf", ".jar", ".apk"]
IMAGES = [".png", ".jpg", ".jpeg", ".tiff", ".tif", ".bmp", ".webp", ".gif", ".heic"]

# MIME types that an extension may have.
EXPECTED_MIMES = {
    ".docx": ["application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/zip"],
    ".xlsx": ["application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "application/zip"],
    ".xls": ["application/vnd.ms-excel"],
    ".pptx": ["application/vnd.openxmlformats-officedocument.presentationml.presentation", "application/zip"],
    ".ppt": ["application/vnd.ms-powerpoint"],
    ".doc": ["application/msword"],
    ".pdf": ["application/pdf"],
    ".sql": ["text/plain", "application/sql", "text/x-sql"],
    ".csv": ["text/plain", "text/csv"],
    ".json": ["text/plain", "application/json"],
    ".txt": ["text/plain"],
    ".xml": ["text/plain", "text/xml", "application/xml"],
    ".png": ["image/png"],
    ".jpg": ["image/jpeg"],
    ".jpeg": ["image/jpeg"],
    ".tiff": ["image/tiff"],
    ".tif": ["image/tiff"],
    ".bmp": ["image/bmp", "image/x-ms-bmp"],
    ".webp": ["image/webp"],
    ".gif": ["image/gif"],
    ".heic": ["image/heic"],
}

# First bytes (hexadecimal) of executables.
EXECUTABLES = [("4D5A", "PE/EXE executable"), ("7F454C46", "ELF executable"), ("FEEDFACE", "Mach-O executable"), ("FEEDFACF", "Mach-O 64 executable"), ("CAFEBABE", "Java class / Mach-O fat"), ("CEFAEDFE", "Mach-O reverse"), ("CFFAEDFE", "Mach-O 64 reverse")]

# First bytes (hexadecimal) of known types, in order; an offset where they aren't first.
MAGIC = [("25504446", 1, "application/pdf"), ("4D5A", 1, "application/x-dosexec"), ("7F454C46", 1, "application/x-elf"), ("89504E470D0A1A0A", 1, "image/png"), ("FFD8FF", 1, "image/jpeg"), ("49492A00", 1, "image/tiff"), ("4D4D002A", 1, "image/tiff"), ("424D", 1, "image/bmp"), ("RIFF", 0, "image/webp"), ("474946383761", 1, "image/gif"), ("474946383961", 1, "image/gif"), ("66747970", 5, "image/heic"), ("504B0304", 1, "application/zip"), ("D0CF11E0A1B11AE1", 1, "application/vnd.ms-excel")]

# Patterns.
SQL_DESTRUCTIVE = r"\bDROP\s+(?:TABLE|DATABASE|SCHEMA)|\bTRUNCATE\s+TABLE|\bALTER\s+TABLE\s+\S+\s+DROP|\b(?:EXEC\s*\(|EXECUTE\s*\()|\bxp_cmdshell\b|\bsp_OACreate\b|\bLOAD_FILE\s*\(|\bINTO\s+(?:OUTFILE|DUMPFILE)\b|\bCOPY\s+[^\n]*\bFROM\s+PROGRAM\b"
CSV_FORMULA = r"^[=+\-@][^\n]*(?:CMD\s*[\(|]|SYSTEM\s*\(|EXEC\s*\(|HYPERLINK\s*\(|IMPORTXML\s*\(|IMPORTDATA\s*\(|MSEXCEL\s*\||\|cmd|\|powershell|\|bash|\|calc)"
JSON_SCRIPT = r"<script|javascript:|onerror\s*=|onload\s*="
JSON_KEYS = ["__proto__", "constructor", "prototype"]
TEXT_SCRIPT = r"<script[\s>]|<\?php|<%[\s=@]|\binvoke-expression\b|\bIEX\s*\(|\bNew-Object\s+System\.Net\.WebClient\b"
BASE64_PE = r"TVqQ[A-Za-z0-9+/=]{40,}|TVpQ[A-Za-z0-9+/=]{40,}"
TEXT_SCHEMES = r"data:text/html|javascript:|vbscript:"
PDF_URI = r"/URI\s*\((?:javascript:|data:text/html|vbscript:)"
PDF_SCRIPT = ["/JAVASCRIPT", "/JS ", "/JS(", "/JS<"]
POLYGLOT = ["<html", "<script", "<?php", "<%"]
SHEBANGS = ["/bin/", "/usr/", "python", "perl", "ruby", "node"]


def scan_extension(name: Column) -> Column:
    """The extension as the scanner sees it: lower-cased, with its dot; a name's leading dots don't begin one."""
    return F.lower(F.coalesce(F.regexp_extract(F.coalesce(name, F.lit("")), r"[^./][^/]*?(\.[^./]*)$", 1), F.lit("")))


def route_extension(name: Column) -> Column:
    """The extension as the format router sees it: what follows the last dot, lower-cased, with a dot; empty without one."""
    return F.when(F.instr(name, ".") > 0, F.concat(F.lit("."), F.lower(F.substring_index(name, ".", -1)))).otherwise("")


def inner_extension(name: Column) -> Column:
    """The extension before the extension."""
    return scan_extension(F.regexp_replace(F.coalesce(name, F.lit("")), r"(?<=[^./])\.[^./]*$", ""))


def starts(content: Column, hexadecimal: str, at: int = 1) -> Column:
    return F.hex(F.substring(content, at, len(hexadecimal) // 2)) == hexadecimal


def holds(content: Column, text: str) -> Column:
    """The bytes of an ASCII text are somewhere in content."""
    return F.contains(content, F.lit(text.encode()))


def latin(content: Column) -> Column:
    """Each byte as one character."""
    return F.decode(content, "ISO-8859-1")


def utf8(content: Column) -> Column:
    """Content as text; bytes that are not UTF-8 are left out, and so are replacement characters."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("\ufffd"), F.lit(""))


def is_webp(content: Column) -> Column:
    return starts(content, "52494646") & starts(content, "57454250", 9)


def mime(content: Column) -> Column:
    """The MIME type by first bytes; empty if none is known."""
    out = F.lit("")
    for magic, at, kind in reversed(MAGIC):
        fits = is_webp(content) if magic == "RIFF" else starts(content, magic, at) & (F.octet_length(content) >= 12) if at > 1 else starts(content, magic)
        out = F.when(fits, kind).otherwise(out)
    return out


def guessed_mimes() -> dict[str, str]:
    """What the standard table of file names says for each extension, or nothing."""
    import mimetypes

    return {e: m for e in EXTENSIONS if (m := mimetypes.guess_type(f"x{e}")[0])}


def check_type(name: Column, content: Column) -> Column:
    """Size, extension, double extension, and a type that neither bytes nor name agree with."""
    ext, inner, size = scan_extension(name), inner_extension(name), F.octet_length(content)
    guessed = guessed_mimes()
    odd = [e for e, kinds in EXPECTED_MIMES.items() if e in guessed and guessed[e] not in kinds]
    expected = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for pair in EXPECTED_MIMES.items() for x in pair])
    found = mime(content)
    mismatch = ext.isin(odd) & (found != "") & ~F.array_contains(F.coalesce(F.try_element_at(expected, ext), F.array(F.lit(""))), found) if odd else F.lit(False)
    return (
        F.when(size > MAX_FILE_BYTES, F.concat(F.lit("File too large ("), F.floor(size / (1024 * 1024)).cast("string"), F.lit(" MB). Maximum is 50 MB")))
        .when(~ext.isin(EXTENSIONS), F.concat(F.lit('File type "'), ext, F.lit('" is not allowed')))
        .when(inner.isin(DANGEROUS_INNER), F.concat(F.lit('Double extension detected ("'), inner, ext, F.lit('")')))
        .when(mismatch, F.concat(F.lit('File type mismatch: extension is "'), ext, F.lit('" but content appears to be "'), found, F.lit('"')))
    )


def check_executable(content: Column) -> Column:
    out = F.lit(None).cast("string")
    later = F.substring(content, 5, 2147483647)
    out = F.when(holds(later, "MZ") & holds(content, "This program"), "Embedded executable detected inside file").otherwise(out)
    line = F.lower(F.split(latin(F.substring(content, 1, SHEBANG_HEAD)), "\n", 2)[0])
    script = F.lit(False)
    for s in SHEBANGS:
        script = script | line.contains(s)
    out = F.when(starts(content, "2321") & script, "File is a script (shebang detected)").otherwise(out)
    for magic, what in reversed(EXECUTABLES):
        out = F.when(starts(content, magic), f"File is a {what}").otherwise(out)
    return out


def check_legacy_office(content: Column) -> Column:
    return F.when(holds(content, "VBA") & holds(content, "Macro"), "VBA macro detected in legacy Office file")


def check_pdf(content: Column) -> Column:
    text = F.upper(latin(content))
    script = F.lit(False)
    for m in PDF_SCRIPT:
        script = script | text.contains(m)
    opens = text.contains("/OPENACTION") | text.contains("/AA ") | text.contains("/AA>")
    acts = text.contains("/JAVASCRIPT") | text.contains("/JS") | text.contains("/LAUNCH")
    return (
        F.when(~starts(content, "25504446"), "Invalid PDF (missing PDF header)")
        .when(script, "JavaScript detected in PDF")
        .when(opens & acts, "Auto-execution action with script detected in PDF")
        .when(text.contains("/LAUNCH"), "Launch action detected in PDF (potential command execution)")
        .when(text.contains("/EMBEDDEDFILE") & text.contains("/FILESPEC"), "Embedded file detected in PDF")
        .when(latin(content).rlike(f"(?i){PDF_URI}"), "Suspicious URI scheme detected in PDF")
    )


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _first(text: Column, pattern: str, chars: int) -> Column:
    return F.substring(_stripped(F.regexp_extract(text, f"(?iU){pattern}", 0)), 1, chars)


def check_sql(text: Column) -> Column:
    found = _first(text, SQL_DESTRUCTIVE, 60)
    return F.when(text.rlike(f"(?iU){SQL_DESTRUCTIVE}"), F.concat(F.lit('Destructive SQL statement detected: "'), found, F.lit('"'))).when(text.contains("/*!"), "MySQL conditional comment obfuscation detected in SQL")


def check_csv(text: Column) -> Column:
    """The first cell, by row and column, that begins a formula with a dangerous call, in the first 2000 lines."""
    lines = F.slice(F.split(text, "\n", -1), 1, CSV_LINES)

    def cell(x: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(_stripped(x), '^"+|"+$', ""), "^'+|'+$", "")

    def first(line: Column, at: Column) -> Column:
        bad = F.filter(F.transform(F.split(line, ",", -1), cell), lambda c: c.rlike(f"(?iU){CSV_FORMULA}"))
        return F.when(F.size(bad) > 0, F.struct((at + 1).alias("row"), bad[0].alias("cell")))

    found = F.get(F.filter(F.transform(lines, first), lambda x: x.isNotNull()), F.lit(0))
    reason = F.concat(F.lit("Formula injection detected in CSV (row "), found["row"].cast("string"), F.lit('): "'), F.substring(found["cell"], 1, 80), F.lit('"'))
    return F.when(text.rlike(r"(?iU)(?:CMD|SYSTEM|EXEC|HYPERLINK|IMPORTXML|IMPORTDATA|MSEXCEL|\|powershell|\|bash|\|calc)"), reason)


def json_depth(text: Column) -> Column:
    """The greatest number of open brackets in the first characters; brackets in strings count too."""
    marks = F.regexp_extract_all(F.substring(text, 1, JSON_HEAD), F.lit(r"([\[\]{}])"), F.lit(1))
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def add(acc: Column, m: Column) -> Column:
        now = acc["now"] + F.when(m.isin("{", "["), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(marks, zero, add, lambda acc: acc["most"])


def check_json_depth(text: Column) -> Column:
    return F.when(json_depth(text) > MAX_JSON_DEPTH, f"JSON nesting depth exceeds limit ({MAX_JSON_DEPTH})")


def check_text(text: Column) -> Column:
    found = _first(text, TEXT_SCRIPT, 40)
    return (
        F.when(text.rlike(f"(?iU){TEXT_SCRIPT}"), F.concat(F.lit('Embedded script/code detected in text file: "'), found, F.lit('"')))
        .when(text.rlike(BASE64_PE), "Base64-encoded executable payload detected in text file")
        .when(text.rlike(f"(?iU){TEXT_SCHEMES}"), "Suspicious URI scheme detected in text file")
    )


def png_pixels(content: Column) -> tuple[Column, Column]:
    """(width, height) of a PNG header."""
    return tuple(F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("long") for at in (17, 21))


def _grouped(n: Column) -> Column:
    return F.format_number(n, 0)


def check_image(ext: Column, content: Column) -> Column:
    width, height = png_pixels(content)
    pixels = width * height
    bomb = F.concat(F.lit("Image bomb detected: "), width.cast("string"), F.lit("x"), height.cast("string"), F.lit(" = "), _grouped(pixels), F.lit(f" pixels (max {MAX_PIXELS:,})"))
    large = (F.octet_length(content) >= 24) & (width.cast("double") * height > MAX_PIXELS)
    region = F.substring(content, 101, POLYGLOT_HEAD)
    out = (
        F.when((ext == ".png") & ~starts(content, "89504E470D0A1A0A"), "Invalid PNG file (bad magic bytes)")
        .when((ext == ".png") & large, bomb)
        .when(ext.isin(".jpg", ".jpeg") & ~starts(content, "FFD8FF"), "Invalid JPEG file (bad magic bytes)")
        .when(ext.isin(".tiff", ".tif") & ~(starts(content, "49492A00") | starts(content, "4D4D002A")), "Invalid TIFF file (bad magic bytes)")
        .when((ext == ".bmp") & ~starts(content, "424D"), "Invalid BMP file (bad magic bytes)")
        .when((ext == ".webp") & ~is_webp(content), "Invalid WebP file (bad magic bytes)")
        .when((ext == ".gif") & ~(starts(content, "474946383761") | starts(content, "474946383961")), "Invalid GIF file (bad magic bytes)")
        .when((ext == ".heic") & (F.octet_length(content) >= 12) & ~starts(content, "66747970", 5), "Invalid HEIC file (bad magic bytes)")
    )
    for marker in POLYGLOT:
        out = out.when(holds(region, marker), f'Polyglot file detected: image contains embedded "{marker}" content')
    head = F.lower(latin(F.substring(content, 1, EXIF_HEAD)))
    return out.when(head.contains("<script") | head.contains("javascript:"), "Script injection detected in image metadata (EXIF)")


def zip_reason(ext: str, data: bytes) -> str | None:
    """What an Office file hides in its parts; a part that can't be read is passed over."""
    try:
        parts = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        return "Invalid Office document (corrupted ZIP structure)"
    names = parts.namelist()
    lower = "\n".join(names).lower()
    if "vbaproject.bin" in lower or "vbadata.xml" in lower:
        return "VBA macro detected in Office document"
    if "oleobject" in lower:
        return "Embedded OLE object detected in Office document"

    def contents(fits) -> Iterator[str]:
        for n in filter(fits, names):
            try:
                yield parts.read(n).decode("utf-8", "ignore")
            except Exception:  # noqa: BLE001  broken or encrypted parts show nothing
                continue

    for x in map(str.lower, contents(lambda n: n.endswith(".rels"))):
        if 'targetmode="external"' in x and re.search("attachedtemplate|oleobject|frame", x):
            return "External template injection detected in Office document"
    if ext == ".xlsx" and any(re.search(r"=DDE\(|=CMD\||DDEAUTO|=MSEXCEL\|", x.upper()) for x in contents(lambda n: re.search("sharedstrings|sheet", n.lower()))):
        return "DDE command injection detected in spreadsheet"
    if ext == ".docx" and any("DDEAUTO" in x or "DDE" in x and "INSTRTEXT" in x for x in map(str.upper, contents(lambda n: "document.xml" in n.lower()))):
        return "DDE command injection detected in document"
    return None


def json_reason(text: str) -> str | None:
    """The first bad key, string or depth of a JSON tree, in document order; text that isn't JSON has none."""
    try:
        tree = json.loads(text)
    except (ValueError, RecursionError):
        return None
    script = re.compile(JSON_SCRIPT, re.I)

    def of_string(s: str) -> str | None:
        if len(s) > MAX_JSON_STRING:
            return "JSON string value exceeds 1 MB"
        return "Script injection detected in JSON value" if script.search(s) else None

    todo: list[tuple[object, object, int]] = [(None, tree, 0)]  # (key, value, depth), the next one last
    while todo:
        key, value, depth = todo.pop()
        if key in JSON_KEYS:
            return f'Prototype pollution key detected: "{key}"'
        if isinstance(value, str):
            if reason := of_string(value):
                return reason
        if depth > MAX_JSON_DEPTH:
            return f"JSON nesting depth exceeds limit ({MAX_JSON_DEPTH})"
        if isinstance(value, dict):
            todo += [(k, v, depth + 1) for k, v in reversed(value.items())]
        elif isinstance(value, list):
            todo += [(None, v, depth + 1) for v in reversed(value)]
    return None


@F.pandas_udf(T.StringType())
def office_scan(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for exts, contents in batches:
        yield pd.Series([zip_reason(e, bytes(c)) if c is not None else None for e, c in zip(exts, contents)], dtype=object)


@F.pandas_udf(T.StringType())
def json_scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([json_reason(t) if t is not None else None for t in texts], dtype=object)


def native_reason(name: Column, content: Column) -> Column:
    """The first reason of all rules but those that look into ZIP parts and JSON trees; null if there is none."""
    ext, text = scan_extension(name), utf8(content)
    by_format = (
        F.when(ext.isin(".xls", ".doc", ".ppt"), check_legacy_office(content))
        .when(ext == ".pdf", check_pdf(content))
        .when(ext == ".sql", check_sql(text))
        .when(ext == ".csv", check_csv(text))
        .when(ext == ".json", check_json_depth(text))
        .when(ext.isin(".txt", ".xml"), check_text(text))
        .when(ext.isin(IMAGES), check_image(ext, content))
    )
    return F.coalesce(check_type(name, content), check_executable(content), by_format)
