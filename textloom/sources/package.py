"""What a WordprocessingML package holds beside its text: headers, footers, notes
and comments, content that tracked changes cannot carry, and table geometry.

An export is refused where old and new differ in any of it (export_refusals).
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree as ET

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectorized import vectorized
from .docx import _W, _children, _val, run_text, xml_part

_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_REL = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"
MAIN = "word/document.xml"
#: Parts that stand beside the main document, by the last step of their relationship's type.
ANCILLARY = ("header", "footer", "footnotes", "endnotes", "comments")
#: Attributes that editors renew at every save.
_VOLATILE = re.compile(r"(?:^|\})(?:rsid\w*|paraId|textId|durableId)$")


def _relationships(z: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str, bool]]:
    """id -> (type, target, external) of a part; inner targets are package paths."""
    folder, name = posixpath.split(part)
    root = xml_part(z, f"{folder}/_rels/{name}.rels")
    out = {}
    for r in root.iter(_REL) if root is not None else ():
        external, target = r.get("TargetMode") == "External", r.get("Target") or ""
        if not external:
            target = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
        out[r.get("Id")] = ((r.get("Type") or "").rsplit("/", 1)[-1], target, external)
    return out


def _payload(z: zipfile.ZipFile, relation: tuple[str, str, bool] | None) -> str:
    """An outer target as it is, an inner one as the hash of its bytes."""
    if relation is None:
        return "missing"
    kind, target, external = relation
    if external:
        return f"{kind}>{target}"
    try:
        return f"{kind}:{hashlib.sha256(z.read(target)).hexdigest()}"
    except KeyError:
        return f"{kind}:missing"


def canonical(e: ET.Element, resolve) -> str:
    """An element as text: attributes sorted, volatile ones left out, relationship
    ids as what they lead to."""
    shown = sorted((k, resolve(v) if k.startswith(_R) else v) for k, v in e.attrib.items() if not _VOLATILE.search(k))
    inner = "".join(canonical(c, resolve) + (c.tail or "").strip() for c in e)
    text = (e.text or "") if e.tag.endswith("}t") else (e.text or "").strip()
    return f"<{e.tag} {shown}>{text}{inner}</>"


def ancillary(raw: bytes) -> list[tuple[str, int, str]]:
    """(kind, ordinal, signature) of the parts beside the text, in the order of
    their references in the document (headers, footers) or of their names."""
    out, count = [], {}
    with zipfile.ZipFile(io.BytesIO(bytes(raw))) as z:
        relations, body = _relationships(z, MAIN), xml_part(z, MAIN)
        used = [x.get(f"{_R}id") for x in body.iter() if x.tag in (f"{_W}headerReference", f"{_W}footerReference")]
        rest = sorted((i for i, r in relations.items() if r[0] in ANCILLARY[2:]), key=lambda i: relations[i][1])
        for ident in used + rest:
            kind, target, external = relations.get(ident, ("missing", "", True))
            root = None if external else xml_part(z, target)
            inner = {} if root is None else _relationships(z, target)
            shape = "missing" if root is None else canonical(root, lambda v: _payload(z, inner.get(v)))
            out.append((kind, count.get(kind, 0), hashlib.sha256(shape.encode()).hexdigest()))
            count[kind] = count.get(kind, 0) + 1
    return out


def _special(e: ET.Element) -> tuple[str, str] | None:
    """(kind, value) of an element that a tracked text change cannot carry."""
    tag = e.tag.removeprefix(_W)
    if tag == "instrText":
        return "field", (e.text or "").strip()
    if tag == "fldSimple":
        return "field", (_val(e, "instr") or "").strip()
    if tag == "sym":
        return "symbol", f"{_val(e, 'font')}:{_val(e, 'char')}"
    if tag == "br" and _val(e, "type") not in (None, "textWrapping"):
        return "break", _val(e, "type")
    if tag in ("softHyphen", "noBreakHyphen", "commentReference", "footnoteReference", "endnoteReference"):
        return tag, _val(e, "id") or ""
    if tag == "bookmarkStart":
        return "bookmark", _val(e, "name") or ""
    return None


def special_content(raw: bytes) -> list[tuple[int, str, str, str, int]]:
    """(ordinal, kind, value, owner, place): fields, symbols, breaks, hyphens,
    links, bookmarks and note marks in document order; owner is the text of the
    paragraph, place the special's position among its paragraph's."""
    out = []
    with zipfile.ZipFile(io.BytesIO(bytes(raw))) as z:
        relations, body = _relationships(z, MAIN), xml_part(z, MAIN)
        linked = {_val(h, "anchor") for h in body.iter(f"{_W}hyperlink")}
        for p in body.iter(f"{_W}p"):
            owner, place = run_text(p), 0
            for e in p.iter():
                if e.tag == f"{_W}hyperlink":
                    ident = e.get(f"{_R}id")
                    found = ("link", f"#{_val(e, 'anchor')}" if ident is None else _payload(z, relations.get(ident)))
                elif any(k.startswith(_R) for k in e.attrib) and e.tag not in (f"{_W}headerReference", f"{_W}footerReference"):
                    found = ("relationship", _payload(z, relations.get(next(v for k, v in e.attrib.items() if k.startswith(_R)))))
                else:
                    found = _special(e)
                if found is None or (found[0] == "bookmark" and found[1] not in linked):
                    continue
                out.append((len(out), *found, owner, place))
                place += 1
    return out


def tracks_changes(raw: bytes) -> bool:
    """Some part of the document that holds text already tracks changes."""
    names = ("ins", "del", "moveFrom", "moveTo", "rPrChange", "pPrChange", "tblPrChange", "cellIns", "cellDel")
    with zipfile.ZipFile(io.BytesIO(bytes(raw))) as z:
        parts = [n for n in z.namelist() if re.fullmatch(r"word/(document|header\d*|footer\d*|footnotes|endnotes|comments)\.xml", n)]
        return any(e.tag in {f"{_W}{n}" for n in names} for n in parts for e in xml_part(z, n).iter())


def table_geometry(raw: bytes) -> list[tuple]:
    """(table, row, column, span, width, grid, fill) of each cell: width in twips
    is the cell's own or its grid columns' sum, grid the table's column widths."""
    out = []
    with zipfile.ZipFile(io.BytesIO(bytes(raw))) as z:
        body = xml_part(z, MAIN)
    for t, table in enumerate(body.iter(f"{_W}tbl")):
        grid = [int(_val(g, "w") or 0) for g in table.findall(f"{_W}tblGrid/{_W}gridCol")]
        for r, row in enumerate(x for x in _children(table) if x.tag == f"{_W}tr"):
            column = 0
            for cell in (x for x in _children(row) if x.tag == f"{_W}tc"):
                pr = cell.find(f"{_W}tcPr")
                get = lambda tag, name="val": _val(pr.find(f"{_W}{tag}"), name) if pr is not None else None
                span, own = int(get("gridSpan") or 1), get("tcW", "w")
                width = int(own) if own and own.isdigit() and get("tcW", "type") in (None, "dxa") else sum(grid[column : column + span])
                fill = get("shd", "fill")
                out.append((t, r, column, span, width, grid, None if fill in (None, "auto") else fill.upper()))
                column += span
    return out


ancillary_col = vectorized(ancillary, "array<struct<kind:string,ordinal:int,signature:string>>")
special_content_col = vectorized(special_content, "array<struct<ordinal:int,kind:string,value:string,owner:string,place:int>>")
tracks_changes_col = vectorized(tracks_changes, "boolean")
table_geometry_col = vectorized(table_geometry, "array<struct<table:int,row:int,column:int,span:int,width:int,grid:array<int>,fill:string>>")


def ancillary_changes(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = ("doc_id",), content: str = "content") -> DataFrame:
    """(keys, kind, ordinal, change) of headers, footers, notes and comments."""
    side = lambda df, name: df.select(*keys, F.explode(ancillary_col(F.col(content))).alias("p")).select(*keys, "p.kind", "p.ordinal", F.col("p.signature").alias(name))
    both = side(before, "old").join(side(after, "new"), [*keys, "kind", "ordinal"], "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").otherwise("modified")
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).select(*keys, "kind", "ordinal", change.alias("change"))


def export_refusals(pairs: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """pairs with `refusals`, the reasons why new must not be exported as tracked
    changes of old (empty: it may be). old and new are packages; one that is null
    is plain text, which must not meet special content on the other side. Special
    content of two packages is compared by what surrounds it (special.py)."""
    from .special import special_changes

    a, b = F.col(old), F.col(new)
    empty = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    signed = lambda c: empty(F.transform(ancillary_col(c), lambda s: F.concat_ws("\u0001", s["kind"], s["ordinal"], s["signature"])))
    plain = a.isNull() != b.isNull()
    held = F.coalesce(F.size(special_content_col(F.coalesce(a, b))), F.lit(0))
    moved = special_changes(pairs, old, new).select(F.col("old").alias("__old"), F.col("new").alias("__new")).distinct()
    on = (F.sha2(a, 256) == F.col("__old")) & (F.sha2(b, 256) == F.col("__new"))
    reasons = [
        (F.coalesce(tracks_changes_col(b), F.lit(False)), "revisions"),
        (plain & (held > 0), "formats"),
        (F.col("__old").isNotNull(), "special content"),
        (~plain & (signed(a) != signed(b)), "ancillary parts"),
    ]
    return pairs.join(moved, on, "left").withColumn("refusals", F.filter(F.array(*[F.when(c, r) for c, r in reasons]), lambda x: x.isNotNull())).drop("__old", "__new")


def paragraph_context(rows: DataFrame, keys: tuple[str, ...], order: str, text: str = "text", reach: int = 8) -> DataFrame:
    """rows with `before` and `after`, up to `reach` neighbouring texts, and `nth`,
    the number of this text among its equals."""
    w = Window.partitionBy(*keys).orderBy(order)
    near: Column = F.collect_list(text)
    nth = F.row_number().over(Window.partitionBy(*keys, F.xxhash64(text)).orderBy(order))
    return rows.withColumns({"before": near.over(w.rowsBetween(-reach, -1)), "after": near.over(w.rowsBetween(1, reach)), "nth": nth})
