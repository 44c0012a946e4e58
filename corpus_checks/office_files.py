"""Minimal office packages with a given text, to have files to read and mask.

Worker-side helper of the checks; the engine itself never makes a package.
"""

import io
import zipfile
from xml.sax.saxutils import escape

# Namespaces of the minimal packages.
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PKG = "http://schemas.openxmlformats.org/package/2006"
_WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_SLIDE = "http://schemas.openxmlformats.org/presentationml/2006/main"
_DRAW = "http://schemas.openxmlformats.org/drawingml/2006/main"
_SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"

SLIDE_LINES = 8
SHARED_FROM = 20


def rels(pairs):
    items = "".join(
        f'<Relationship Id="rId{i}" Type="{_REL}/{kind}" Target="{target}"/>'
        for i, (kind, target) in enumerate(pairs, 1)
    )
    return f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{_PKG}/relationships">{items}</Relationships>'


def package(parts):
    types = f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="{_PKG}/content-types"></Types>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as target:
        for name, body in {"[Content_Types].xml": types, **parts}.items():
            target.writestr(zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0)), body)
    return out.getvalue()


def runs_of(line):
    """A line cut after every '. '; an empty line has no runs."""
    if not line:
        return []
    pieces = line.split(". ")
    return [p + ". " for p in pieces[:-1]] + [pieces[-1]]


def docx_from_paragraphs(paragraphs, tail=""):
    body = "".join(
        "<w:p>" + "".join(f'<w:r><w:t xml:space="preserve">{escape(r)}</w:t></w:r>' for r in runs) + "</w:p>"
        for runs in paragraphs
    )
    document = f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{_WORD}"><w:body>{body}{tail}</w:body></w:document>'
    return package({"_rels/.rels": rels([("officeDocument", "word/document.xml")]),
                    "word/document.xml": document})


def docx(text):
    """One paragraph per line, one run per sentence."""
    return docx_from_paragraphs([runs_of(line) for line in text.split("\n")])


def pptx_from_slides(slides):
    parts = {"_rels/.rels": rels([("officeDocument", "ppt/presentation.xml")])}
    parts["ppt/_rels/presentation.xml.rels"] = rels(
        [("slide", f"slides/slide{i}.xml") for i in range(1, len(slides) + 1)]
    )
    parts["ppt/presentation.xml"] = f'<p:presentation xmlns:p="{_SLIDE}"/>'
    for i, runs in enumerate(slides, 1):
        body = "".join(f"<a:p><a:r><a:t>{escape(r)}</a:t></a:r></a:p>" for r in runs)
        parts[f"ppt/slides/slide{i}.xml"] = f'<p:sld xmlns:p="{_SLIDE}" xmlns:a="{_DRAW}">{body}</p:sld>'
    return package(parts)


def pptx(text):
    """One run per line, SLIDE_LINES lines per slide."""
    lines = text.split("\n")
    return pptx_from_slides(
        [lines[i : i + SLIDE_LINES] for i in range(0, len(lines), SLIDE_LINES)]
    )


def xlsx_from_parts(cells, shared, extra=None):
    rows = "".join(f'<row r="{i}">{cell}</row>' for i, cell in enumerate(cells, 1))
    related = [("worksheet", "worksheets/sheet1.xml")]
    parts = {
        "_rels/.rels": rels([("officeDocument", "xl/workbook.xml")]),
        "xl/workbook.xml": f'<workbook xmlns="{_SHEET}"/>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{_SHEET}"><sheetData>{rows}</sheetData></worksheet>',
    }
    if shared is not None:
        related.append(("sharedStrings", "sharedStrings.xml"))
        items = "".join(f"<si><t>{escape(s)}</t></si>" for s in shared)
        parts["xl/sharedStrings.xml"] = f'<sst xmlns="{_SHEET}">{items}</sst>'
    for kind, name, body in extra or []:
        related.append((kind, name))
        parts[f"xl/{name}"] = body
    parts["xl/_rels/workbook.xml.rels"] = rels(related)
    return package(parts)


def xlsx(text):
    """One cell per line: a shared string from SHARED_FROM characters on, else inline.
    The shared strings are all lines in order, so a cell's index is its line."""
    lines = text.split("\n")
    cells = [
        f'<c r="A{i + 1}" t="s"><v>{i}</v></c>' if len(line) >= SHARED_FROM
        else f'<c r="A{i + 1}" t="inlineStr"><is><t>{escape(line)}</t></is></c>'
        for i, line in enumerate(lines)
    ]
    return xlsx_from_parts(cells, lines)


BUILDERS = {".docx": docx, ".pptx": pptx, ".xlsx": xlsx}


def build(ext, text):
    maker = BUILDERS.get(ext)
    return maker(text) if maker else text.encode()
