"""Review spreadsheets and tracked-changes documents as bytes, by zipfile alone.

Writers make one file of one comparison; write_files() makes the files of many in
tasks, each written beside and moved, so a repeated task replaces it whole.
"""

from __future__ import annotations

import io
import os
import re
import uuid
import zipfile
from urllib.parse import quote
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.text import LEXERS, match_key
from ..operators.align import paragraphs
from ..operators.diff import compact_gaps, lcs_pairs

_BAD = re.compile("[^\t\n\r -퟿-�\U00010000-\U0010ffff]")
_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'


def xml(text: str) -> str:
    return escape(_BAD.sub("", text), {'"': "&quot;"})


def _package(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))  # equal input, equal bytes
            info.compress_type = zipfile.ZIP_DEFLATED
            z.writestr(info, _HEAD + text)
    return out.getvalue()


def column_name(n: int) -> str:
    """0 -> A, 26 -> AA."""
    s = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        s = chr(65 + r) + s
    return s


#: Run properties in the order of the schema; the colours are our own.
_FONT = {"normal": "", "delete": "<strike/><color rgb=\"FFA8201A\"/>", "insert": "<color rgb=\"FF14746F\"/><u/>", "both": "<strike/><color rgb=\"FF6A4C93\"/><u/>"}
#: Cell formats by what a row is: number of the format in styles.xml.
FORMATS = {"text": 1, "header": 2, "section": 3, "changed": 4, "message": 5}


#: Column widths of texts and of messages, in characters.
WIDTHS = [46, 46, 46, 24]


def _xf(font: int, fill: int) -> str:
    return f'<xf fontId="{font}" fillId="{fill}" applyFont="1" applyFill="1" applyAlignment="1"><alignment wrapText="1" vertical="top"/></xf>'


def row_height(cells: list[str], widths: list[int], heading: bool = False) -> int:
    """Points of a row: 15 a line and 6, at most 409, at least 24 for headings;
    characters beyond ASCII count double."""
    lines = [sum(max(1, -(-sum(1 + (ord(x) > 127) for x in line) // w)) for line in text.split("\n")) for text, w in zip(cells, widths)]
    high = min(409, 6 + 15 * max(lines, default=1))
    return max(24, high) if heading else high


def spreadsheet(header: list[str], rows: list[list[list[tuple[str, str]]]], widths: list[int], name: str = "Review", kinds: list[str] | None = None) -> bytes:
    """A one-sheet workbook; a cell is a list of (style, text) runs, and kinds are the
    FORMATS of rows (the last column of text rows holds messages)."""
    kinds = kinds or ["text"] * len(rows)

    def cell(r, c, runs, kind):
        at = f"{column_name(c)}{r}"
        form = FORMATS["message" if kind == "text" and c == len(widths) - 1 else kind]
        body = "".join(f'<r><rPr>{_FONT[s]}</rPr><t xml:space="preserve">{xml(t)}</t></r>' if _FONT[s] else f'<r><t xml:space="preserve">{xml(t)}</t></r>' for s, t in runs if t)
        return f'<c r="{at}" t="inlineStr" s="{form}"><is>{body or "<t/>"}</is></c>'

    every = [([[("normal", h)] for h in header], "header"), *zip(rows, kinds)]
    high = lambda cells, kind: row_height(["".join(t for _, t in runs) for runs in cells], widths, kind in ("header", "section"))
    body = "".join(f'<row r="{i}" ht="{high(cells, kind)}" customHeight="1">{"".join(cell(i, c, runs, kind) for c, runs in enumerate(cells))}</row>' for i, (cells, kind) in enumerate(every, 1))
    cols = "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(widths, 1))
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    return _package(
        {
            "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>',
            "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{xml(name[:31])}" sheetId="1" r:id="rId1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{rel}/styles" Target="styles.xml"/></Relationships>',
            "xl/styles.xml": f'<styleSheet xmlns="{main}"><fonts count="3"><font/><font><b/></font><font><color rgb="FF555555"/></font></fonts><fills count="5"><fill/><fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FFD9E2E1"/></patternFill></fill><fill><patternFill patternType="solid"><fgColor rgb="FFEFEFEF"/></patternFill></fill><fill><patternFill patternType="solid"><fgColor rgb="FFFFF8E6"/></patternFill></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="6"><xf/>{_xf(0, 0)}{_xf(1, 2)}{_xf(1, 3)}{_xf(0, 4)}{_xf(2, 0)}</cellXfs></styleSheet>',
            "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><cols>{cols}</cols><sheetData>{body}</sheetData></worksheet>',
        }
    )


def _runs(old: str, new: str) -> list[tuple[str, str]]:
    """Word runs of an edited line."""
    a, b = LEXERS["diff"].findall(old), LEXERS["diff"].findall(new)
    out, i, j = [], 0, 0
    for _, p, q, r, s in [*compact_gaps(lcs_pairs(a, b), len(a), len(b)), ("", len(a), len(a), len(b), len(b))]:
        out += [("normal", "".join(b[j:r])), ("delete", "".join(a[p:q])), ("insert", "".join(b[r:s]))]
        i, j = q, s
    return [x for x in out if x[1]]


def aligned_lines(old: str, new: str) -> list[tuple[str | None, str | None]]:
    """Lines of two texts side by side, in order."""
    a, b = old.split("\n"), new.split("\n")
    pairs, out, i, j = paragraphs([match_key(x) for x in a], [match_key(x) for x in b]), [], 0, 0
    for p, q in [*pairs, (len(a), len(b))]:
        out += [(x, None) for x in a[i:p]] + [(None, y) for y in b[j:q]]
        if p < len(a) and q < len(b):
            out.append((a[p], b[q]))
        i, j = p + 1, q + 1
    return out


def positional_lines(old: str, new: str) -> list[tuple[str | None, str | None]]:
    """Lines of two texts side by side: equal lines in order, and between them the
    first with the first."""
    a, b = old.split("\n"), new.split("\n")
    out, i, j = [], 0, 0
    for p, q in [*lcs_pairs(a, b), (len(a), len(b))]:
        out += [(a[i + k] if i + k < p else None, b[j + k] if j + k < q else None) for k in range(max(p - i, q - j))]
        if p < len(a) and q < len(b):
            out.append((a[p], b[q]))
        i, j = p + 1, q + 1
    return out


def pair_sheet(old: str, new: str) -> bytes:
    """Before, after and what changed, a line a row."""
    rows = []
    for x, y in aligned_lines(old, new):
        runs = _runs(x, y) if x is not None and y is not None else [("delete", x)] if y is None else [("insert", y)]
        rows.append([[(s, t) for s, t in runs if s != "insert"], [(s, t) for s, t in runs if s != "delete"], [("normal", "" if x == y else "added" if x is None else "deleted" if y is None else "changed")]])
    return spreadsheet(["Before", "After", "Change"], rows, WIDTHS[:2] + WIDTHS[-1:], kinds=["changed" if r[-1][0][1] else "text" for r in rows])


def three_way_lines(a: str, b: str, c: str) -> list[tuple[str | None, str | None, str | None]]:
    """Lines of three texts: A-B rows, each with the C line of its B line, and
    lines that only C has where they stand."""
    ab, bc = aligned_lines(a, b), aligned_lines(b, c)
    out, k = [], 0
    for x, y in ab:
        if y is None:
            out.append((x, None, None))
            continue
        while k < len(bc) and bc[k][0] is None:
            out.append((None, None, bc[k][1]))
            k += 1
        out.append((x, y, bc[k][1] if k < len(bc) else None))
        k += 1
    return out + [(None, None, z) for y, z in bc[k:] if y is None]


def three_way_sheet(a: str, b: str, c: str) -> bytes:
    rows = [[*[[("normal", t or "")] for t in row], [("normal", "" if len(set(row)) == 1 else "changed")]] for row in three_way_lines(a, b, c)]
    return spreadsheet(["A", "B", "C", "Changes"], rows, WIDTHS, kinds=["changed" if r[-1][0][1] else "text" for r in rows])


def tracked_document(old: str, new: str, author: str = "textloom", date: str = "2000-01-01T00:00:00Z") -> bytes:
    """The new text as a document with tracked changes from the old one: accepting
    all gives the new text, rejecting all the old one."""
    ident = iter(range(1, 1 << 30))
    lines = positional_lines(old, new)
    mark = lambda tag: f'<w:{tag} w:id="{next(ident)}" w:author="{xml(author)}" w:date="{date}"'
    body = []
    for x, y in lines:
        whole = "ins" if x is None else "del" if y is None else ""
        runs = [("insert", y)] if x is None else [("delete", x)] if y is None else _runs(x, y)
        props = f"<w:pPr><w:rPr>{mark(whole)}/></w:rPr></w:pPr>" if whole else ""
        made = []
        for style, text in runs:
            tag = "delText" if style == "delete" else "t"
            run = f'<w:r><w:{tag} xml:space="preserve">{xml(text)}</w:{tag}></w:r>'
            made.append(run if style == "normal" else f"{mark('ins' if style == 'insert' else 'del')}>{run}</w:{'ins' if style == 'insert' else 'del'}>")
        body.append(f"<w:p>{props}{''.join(made)}</w:p>")
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    return _package(
        {
            "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/><Override PartName="/word/settings.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.settings+xml"/></Types>',
            "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="word/document.xml"/></Relationships>',
            "word/_rels/document.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/settings" Target="settings.xml"/></Relationships>',
            "word/settings.xml": f"<w:settings {_NS}><w:trackRevisions/></w:settings>",
            "word/document.xml": f"<w:document {_NS}><w:body>{''.join(body)}<w:sectPr/></w:body></w:document>",
        }
    )


def has_revisions(raw: bytes) -> bool:
    """The document already tracks changes; exporting over them is refused."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        return bool(re.search(rb"<w:(?:ins|del|moveFrom|moveTo|rPrChange|pPrChange)\b", z.read("word/document.xml")))


def placed(raw: bytes, path: str) -> None:
    """Write a new file whole. One that is there is never replaced: it is left if it
    holds the same bytes (a repeated task), else it is an error."""
    part = f"{os.path.dirname(path)}/.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.write(raw)
    try:
        os.link(part, path)
    except FileExistsError:
        with open(path, "rb") as f:
            if f.read() != raw:
                raise FileExistsError(f"{path} exists already") from None
    finally:
        os.remove(part)


def write_files(pairs: DataFrame, folder: str, make=pair_sheet, suffix: str = ".xlsx", key: str = "pair_id", old: str = "old", new: str = "new") -> DataFrame:
    """(key, path, bytes) of one file for each pair, in a folder that executors share.
    Names are the keys, other characters than letters, digits, _ . - as %xx, so two
    keys never share a file; a file that exists with other bytes is an error. old and
    new are texts, or packages where make takes them."""
    kinds = dict(pairs.dtypes)
    empty = b"" if kinds[old] == "binary" else ""

    def run(batches):
        for g in batches:
            rows = []
            for k, a, b in zip(g[key], g[old], g[new]):
                raw = make(empty if a is None else a, empty if b is None else b)
                path = f"{folder}/{quote(str(k), safe='')}{suffix}"
                placed(raw, path)
                rows.append((k, path, len(raw)))
            yield pd.DataFrame(rows, columns=[key, "path", "bytes"])

    return pairs.select(key, old, new).mapInPandas(run, f"`{key}` {kinds[key]}, path string, bytes long")
