"""How each format gives up its texts, in order, and takes them back.

`texts_of(data)` lists a file's text units as (address, text); `with_texts(data, texts)` is the file with those texts in their places.
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.dom import minidom


class Unsupported(ValueError):
    """A format that needs software or a model which this library does not have."""


# Formats by extension.
FORMATS = {".txt": "text", ".xml": "text", ".csv": "csv", ".json": "json", ".sql": "sql", ".docx": "docx", ".xlsx": "xlsx", ".pptx": "pptx"}
NEEDS = {
    ".xls": "a reader of the binary spreadsheet format", ".doc": "an office converter", ".ppt": "an office converter", ".pdf": "a PDF library",
    **dict.fromkeys([".png", ".jpg", ".jpeg", ".tiff", ".tif", ".bmp", ".webp", ".gif", ".heic"], "an OCR engine"),
}


def text_of(data: bytes) -> str:
    return data.decode("utf-8", "replace")


def _csv_rows(data: bytes) -> list[list[str]]:
    return list(csv.reader(io.StringIO(text_of(data))))


def csv_texts(data: bytes) -> list[tuple[str, str]]:
    return [(f"{r},{c}", cell) for r, row in enumerate(_csv_rows(data)) for c, cell in enumerate(row)]


def csv_with(data: bytes, texts: list[str]) -> bytes:
    left = iter(texts)
    out = io.StringIO()
    csv.writer(out).writerows([next(left) for _ in row] for row in _csv_rows(data))
    return out.getvalue().encode()


def _strings(node: object, path: tuple) -> Iterator[tuple[tuple, str]]:
    if isinstance(node, str):
        yield path, node
    else:
        for key, value in node.items() if isinstance(node, dict) else enumerate(node) if isinstance(node, list) else ():
            yield from _strings(value, (*path, key))


def json_texts(data: bytes) -> list[tuple[str, str]]:
    return [(json.dumps(path, ensure_ascii=False), s) for path, s in _strings(json.loads(text_of(data)), ())]


def json_with(data: bytes, texts: list[str]) -> bytes:
    """Rewritten strings in their places; a root that is a string is replaced as a whole."""
    left = iter(texts)

    def rebuilt(node: object) -> object:
        if isinstance(node, str):
            return next(left)
        if isinstance(node, dict):
            return {k: rebuilt(v) for k, v in node.items()}
        return [rebuilt(v) for v in node] if isinstance(node, list) else node

    return json.dumps(rebuilt(json.loads(text_of(data))), indent=2, ensure_ascii=False).encode()


#: Comments, quoted literals, ends of statements, and what is between them.
SQL_TOKEN = re.compile(r"--[^\n]*|/\*.*?(?:\*/|\Z)|'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|;|[^;'\"/\-]+|.", re.S)


def _is_literal(token: str) -> bool:
    return len(token) > 1 and token[0] in "'\"" and token[-1] == token[0]


def sql_texts(data: bytes) -> list[tuple[str, str]]:
    return [(f"{k},{t[0]}", t[1:-1]) for k, t in enumerate(SQL_TOKEN.findall(text_of(data))) if _is_literal(t)]


def sql_with(data: bytes, texts: list[str]) -> bytes:
    """Literals get their texts in the same quotes, unescaped; statements come one a line.  Without literals nothing changes."""
    if not texts:
        return text_of(data).encode()
    left = iter(texts)
    statements = [""]
    for t in SQL_TOKEN.findall(text_of(data)):
        statements[-1] += f"{t[0]}{next(left)}{t[0]}" if _is_literal(t) else t
        if t == ";":
            statements.append("")
    return "\n".join(s for s in map(str.strip, statements) if s).encode()


def _parts(data: bytes) -> dict[str, bytes]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return {n: z.read(n) for n in z.namelist()}


def _zipped(parts: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n, v in parts.items():
            z.writestr(n, v)
    return out.getvalue()


def _children(node, *names: str) -> list:
    return [c for c in node.childNodes if c.nodeType == c.ELEMENT_NODE and c.tagName in names]


def _inner(node) -> str:
    return "".join(c.data for c in node.childNodes if c.nodeType in (c.TEXT_NODE, c.CDATA_SECTION_NODE))


def _set_inner(node, text: str) -> None:
    while node.firstChild:
        node.removeChild(node.firstChild)
    node.appendChild(node.ownerDocument.createTextNode(text))
    if text != text.strip():
        node.setAttribute("xml:space", "preserve")


_BREAKS = {"w:tab": "\t", "w:br": "\n", "w:cr": "\n", "a:br": "\v"}


def _run_text(run, mark: str) -> str:
    return "".join(_inner(c) if c.tagName == f"{mark}:t" else _BREAKS.get(c.tagName, "") for c in run.childNodes if c.nodeType == c.ELEMENT_NODE)


class Paragraph:
    """A paragraph of runs; mark is the prefix of its elements."""

    def __init__(self, node, mark: str):
        self.node, self.mark = node, mark
        self.runs = _children(node, f"{mark}:r") if mark == "a" else [r for c in _children(node, "w:r", "w:hyperlink") for r in ([c] if c.tagName == "w:r" else _children(c, "w:r"))]

    @property
    def text(self) -> str:
        if self.mark == "a":
            return "".join("\v" if c.tagName == "a:br" else _run_text(c, "a") for c in _children(self.node, "a:r", "a:br", "a:fld"))
        return "".join(_run_text(r, "w") for r in self.runs)

    def replace(self, text: str) -> None:
        """The first run gets the text and keeps its looks; other runs go, or stay empty on slides."""
        if not self.runs:
            return
        first, *rest = self.runs
        holders = _children(first, f"{self.mark}:t")
        for c in [c for c in first.childNodes if c.nodeType == c.ELEMENT_NODE and c.tagName in ("w:tab", "w:br", "w:cr")] + holders[1:]:
            first.removeChild(c)
        holder = holders[0] if holders else first.appendChild(first.ownerDocument.createElement(f"{self.mark}:t"))
        _set_inner(holder, text)
        for r in rest:
            if self.mark == "w":
                r.parentNode.removeChild(r)
            else:
                for t in _children(r, "a:t"):
                    _set_inner(t, "")


def _docx(parts: dict[str, bytes]) -> tuple[dict, list[Paragraph]]:
    name = "word/document.xml"
    dom = minidom.parseString(parts[name])
    body = _children(dom.documentElement, "w:body")[0]
    nodes = _children(body, "w:p")
    for table in _children(body, "w:tbl"):
        nodes += [p for row in _children(table, "w:tr") for cell in _children(row, "w:tc") for p in _children(cell, "w:p")]
    return {name: dom}, [Paragraph(p, "w") for p in nodes]


def _pptx(parts: dict[str, bytes]) -> tuple[dict, list[Paragraph]]:
    doms, found = {}, []
    for name in sorted((n for n in parts if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0])):
        doms[name] = dom = minidom.parseString(parts[name])
        for tree in dom.getElementsByTagName("p:spTree"):
            for shape in _children(tree, "p:sp", "p:graphicFrame"):
                bodies = _children(shape, "p:txBody") + [b for t in shape.getElementsByTagName("a:tbl") for row in _children(t, "a:tr") for cell in _children(row, "a:tc") for b in _children(cell, "a:txBody")]
                found += [Paragraph(p, "a") for b in bodies for p in _children(b, "a:p")]
    return doms, found


def _paragraph_format(parse: Callable) -> tuple[Callable, Callable]:
    def texts(data: bytes) -> list[tuple[str, str]]:
        return [(str(k), p.text) for k, p in enumerate(parse(_parts(data))[1]) if p.text.strip()]

    def with_texts(data: bytes, new: list[str]) -> bytes:
        parts = _parts(data)
        doms, paragraphs = parse(parts)
        for p, text in zip([p for p in paragraphs if p.text.strip()], new):
            if text != p.text:
                p.replace(text)
        return _zipped(parts | {n: d.toxml(encoding="UTF-8") for n, d in doms.items()})

    return texts, with_texts


def _rich(node) -> str:
    return "".join(_inner(t) for t in _children(node, "t")) + "".join(_inner(t) for r in _children(node, "r") for t in _children(r, "t"))


def _xlsx_cells(parts: dict[str, bytes]) -> tuple[dict, list[tuple[str, object, str]]]:
    """(parsed sheets, (address, cell, text) of each cell that holds a string or a formula)."""
    shared = []
    if "xl/sharedStrings.xml" in parts:
        shared = [_rich(si) for si in _children(minidom.parseString(parts["xl/sharedStrings.xml"]).documentElement, "si")]
    doms, cells = {}, []
    for name in sorted((n for n in parts if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0])):
        doms[name] = dom = minidom.parseString(parts[name])
        for c in dom.getElementsByTagName("c"):
            kind, value, formula, inline = c.getAttribute("t"), _children(c, "v"), _children(c, "f"), _children(c, "is")
            text = "=" + _inner(formula[0]) if formula else shared[int(_inner(value[0]))] if kind == "s" and value else _rich(inline[0]) if inline else _inner(value[0]) if kind == "str" and value else None
            if text is not None:
                cells.append((f"{name.split('/')[-1][:-4]}!{c.getAttribute('r')}", c, text))
    return doms, cells


def xlsx_texts(data: bytes) -> list[tuple[str, str]]:
    return [(at, text) for at, _, text in _xlsx_cells(_parts(data))[1]]


def xlsx_with(data: bytes, texts: list[str]) -> bytes:
    """A changed cell becomes an inline string."""
    parts = _parts(data)
    doms, cells = _xlsx_cells(parts)
    for (_, c, old), new in zip(cells, texts):
        if new != old:
            while c.firstChild:
                c.removeChild(c.firstChild)
            c.setAttribute("t", "inlineStr")
            holder = c.appendChild(c.ownerDocument.createElement("is")).appendChild(c.ownerDocument.createElement("t"))
            _set_inner(holder, new)
    return _zipped(parts | {n: d.toxml(encoding="UTF-8") for n, d in doms.items()})


HANDLERS: dict[str, tuple[Callable, Callable]] = {
    "text": (lambda data: [("", text_of(data))], lambda data, texts: texts[0].encode()),
    "csv": (csv_texts, csv_with),
    "json": (json_texts, json_with),
    "sql": (sql_texts, sql_with),
    "docx": _paragraph_format(_docx),
    "pptx": _paragraph_format(_pptx),
    "xlsx": (xlsx_texts, xlsx_with),
}


def handler(extension: str) -> tuple[Callable, Callable]:
    if extension in FORMATS:
        return HANDLERS[FORMATS[extension]]
    raise Unsupported(f"{extension} needs {NEEDS[extension]}, which is not available" if extension in NEEDS else f"unsupported format: {extension!r}")


def read_pdf(data: bytes):
    raise Unsupported("text of PDF files needs a PDF library, which is not available")


def read_image(data: bytes):
    raise Unsupported("text of images needs an OCR engine, which is not available")


def preprocess_image(data: bytes):
    raise Unsupported("image preprocessing needs an image library, which is not available")


def convert_office(data: bytes, extension: str):
    raise Unsupported(f"{extension} needs an office converter, which is not available")


def analyse_layout(data: bytes):
    raise Unsupported("layout of images needs an OCR engine, which is not available")


def convert_image(data: bytes):
    raise Unsupported("conversion of images needs an image library, which is not available")


def paint_boxes(data: bytes, boxes: list):
    raise Unsupported("painting of images needs an image library, which is not available; `geometry.sub_boxes` gives the boxes")


def write_pdf(data: bytes, texts: list):
    raise Unsupported("rewriting of PDF files needs a PDF library, which is not available")
