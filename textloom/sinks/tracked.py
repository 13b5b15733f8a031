"""Tracked changes inside the revised document's own package.

The revised package is the base: accepting all changes gives it back, with its
formatting, tables, notes and parts; rejecting all gives the old text. Insertions
are marked where they stand, by splitting runs at their edges; what was deleted is
put back as deleted runs in its own formatting, at the place that its neighbours
map to. Paragraphs are aligned in order, tables by the cells that they share, rows
by unique equal rows, cells by their place; a deletion goes to its row, cell or
paragraph and never into another cell.

Runs that hold more than text (fields, drawings, notes) are left untouched. A
package that tracks changes already is refused.
"""

from __future__ import annotations

import copy
import io
import re
import zipfile
from itertools import accumulate
from xml.etree import ElementTree as ET

from ..functions.text import LEXERS, match_key
from ..operators.align import match_tables, paragraphs
from ..operators.diff import compact_gaps, lcs_pairs
from ..sources.docx import _W, MOST_XML, Numbering, run_text, xml_part
from ..sources.package import MAIN, tracks_changes

_REL = "http://schemas.openxmlformats.org/package/2006/relationships"
_TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_SPACE = "{http://www.w3.org/XML/1998/namespace}space"
_THROUGH = {f"{_W}{t}" for t in ("sdt", "sdtContent", "customXml", "smartTag", "hyperlink", "fldSimple")}
#: Content of a run that stands for one visible character each, and what text runs may hold (fixed by the standard).
_MARKS = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n", f"{_W}noBreakHyphen": "‑"}
_PLAIN = {f"{_W}t", f"{_W}rPr", f"{_W}lastRenderedPageBreak", *_MARKS}
_IDS = {f"{_W}{t}" for t in ("ins", "del", "moveFrom", "moveTo", "rPrChange", "pPrChange", "tblPrChange", "trPrChange", "tcPrChange", "sectPrChange", "cellIns", "cellDel", "cellMerge", "numberingChange", "bookmarkStart", "commentRangeStart")}
#: Properties that stand before numPr in a paragraph's, in the schema's order.
_BEFORE_NUMBER = ("pStyle", "keepNext", "keepLines", "pageBreakBefore", "framePr", "widowControl")


def next_revision_id(*roots: ET.Element) -> int:
    """One more than the largest id of any family of revisions and marks."""
    found = (e.get(f"{_W}id", "") for r in roots for e in r.iter() if e.tag in _IDS)
    return max((int(x) for x in found if x.lstrip("-").isdigit()), default=0) + 1


class Package:
    """A package's parts, and its main document with prefixes kept."""

    def __init__(self, raw: bytes):
        with zipfile.ZipFile(io.BytesIO(bytes(raw))) as z:
            if any(i.file_size > MOST_XML for i in z.infolist()):
                raise ValueError(f"a part is larger than {MOST_XML} bytes")
            self.names = z.namelist()
            self.parts = {n: z.read(n) for n in self.names}
            self.numbering = Numbering(xml_part(z, "word/numbering.xml"), xml_part(z, "word/styles.xml"))
        self.root = ET.fromstring(self.parts[MAIN])
        self.body = self.root.find(f"{_W}body")

    def write(self) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for n in [*self.names, *(n for n in self.parts if n not in self.names)]:
                info = zipfile.ZipInfo(n, (1980, 1, 1, 0, 0, 0))  # equal input, equal bytes
                info.compress_type = zipfile.ZIP_DEFLATED
                z.writestr(info, self.parts[n])
        return out.getvalue()


def serialized(root: ET.Element, source: bytes) -> bytes:
    """XML with the prefixes of the part that it comes from, unused ones included:
    attributes such as Ignorable name them."""
    names = dict(v for _, v in ET.iterparse(io.BytesIO(source), events=("start-ns",)))
    for prefix, uri in names.items():
        if prefix and not re.fullmatch(r"ns\d+", prefix):
            ET.register_namespace(prefix, uri)
    text = ET.tostring(root, encoding="unicode")
    head = text[: text.index(">")]
    lost = "".join(f' xmlns:{p}="{u}"' for p, u in names.items() if p and f"xmlns:{p}=" not in head)
    cut = re.match(r"<[^\s/>]+", text).end()
    return ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n' + text[:cut] + lost + text[cut:]).encode()


def _flow(container: ET.Element, kinds=("p", "tbl")):
    """(element, parent) of a container's paragraphs and tables, content controls seen through."""
    for c in container:
        if c.tag in {f"{_W}{k}" for k in kinds}:
            yield c, container
        elif c.tag in _THROUGH:
            yield from _flow(c, kinds)


def _runs(p: ET.Element):
    """(run, parent, text) of a paragraph's visible text runs; text is None for
    runs that hold more than text."""
    for c in p:
        if c.tag == f"{_W}r":
            vanish = c.find(f"{_W}rPr/{_W}vanish")
            if vanish is not None and vanish.get(f"{_W}val") not in ("0", "false"):
                continue
            if all(x.tag in _PLAIN and (x.tag != f"{_W}br" or x.get(f"{_W}type") in (None, "textWrapping")) for x in c):
                yield c, p, "".join(x.text or "" if x.tag == f"{_W}t" else _MARKS.get(x.tag, "") for x in c)
            else:
                yield c, p, None
        elif c.tag in _THROUGH:
            yield from ((r, q if q is not c else c, t) for r, q, t in _runs(c))


def plain_text(p: ET.Element) -> str:
    return "".join(t for _, _, t in _runs(p) if t)


def _piece(run: ET.Element, start: int, end: int, deleted: bool = False) -> ET.Element:
    """The characters start to end of a text run as a run of the same formatting."""
    out, at = ET.Element(run.tag, run.attrib), 0
    for x in run:
        if x.tag == f"{_W}rPr":
            out.append(copy.deepcopy(x))
        elif x.tag == f"{_W}t":
            text = x.text or ""
            a, b = max(start - at, 0), min(end - at, len(text))
            if a < b:
                made = ET.SubElement(out, f"{_W}delText" if deleted else x.tag, {_SPACE: "preserve"})
                made.text = text[a:b]
            at += len(text)
        elif x.tag in _MARKS:
            if start <= at < end:
                out.append(copy.deepcopy(x))
            at += 1
    return out


class Writer:
    def __init__(self, old: Package, new: Package, author: str, date: str):
        self.old, self.new, self.author, self.date = old, new, author, date
        self.ident = next_revision_id(new.root)

    def mark(self, tag: str) -> ET.Element:
        e = ET.Element(f"{_W}{tag}", {f"{_W}id": str(self.ident), f"{_W}author": self.author, f"{_W}date": self.date})
        self.ident += 1
        return e

    # ------------------------------------------------ runs of a paragraph

    def cut(self, p: ET.Element, at: int) -> None:
        """Split the text run that holds the place inside."""
        done = 0
        for run, parent, text in list(_runs(p)):
            if text and done < at < done + len(text):
                i = list(parent).index(run)
                parent.remove(run)
                parent.insert(i, _piece(run, at - done, len(text)))
                parent.insert(i, _piece(run, 0, at - done))
                return
            done += len(text or "")

    def inserted(self, p: ET.Element, start: int, end: int) -> None:
        """Mark the characters start to end as inserted."""
        self.cut(p, start)
        self.cut(p, end)
        done = 0
        for run, parent, text in list(_runs(p)):
            if text and start <= done and done + len(text) <= end and parent.tag != f"{_W}ins":
                i = list(parent).index(run)
                parent.remove(run)
                wrapper = self.mark("ins")
                wrapper.append(run)
                parent.insert(i, wrapper)
            done += len(text or "")

    def deleted_runs(self, p: ET.Element, start: int, end: int) -> list[ET.Element]:
        """The old paragraph's characters start to end as deleted runs in their own formatting."""
        out, done = [], 0
        for run, _, text in _runs(p):
            a, b = max(start - done, 0), min(end - done, len(text or ""))
            if text and a < b:
                wrapper = self.mark("del")
                wrapper.append(_piece(run, a, b, deleted=True))
                out.append(wrapper)
            done += len(text or "")
        return out

    def put_back(self, p: ET.Element, at: int, made: list[ET.Element]) -> None:
        """Place deleted runs before the character at a place, outside of a link or
        field that begins or ends there."""
        self.cut(p, at)
        done, place = 0, None
        for run, parent, text in _runs(p):
            if text is not None and done == at and text:
                place = (parent, run)
                break
            done += len(text or "")
        if place is None:
            p.extend(made)
            return
        parent, run = place
        parents = {c: q for q in p.iter() for c in q}
        while parent is not p and list(parent)[0] is run:  # the wrapper begins here: go before it
            parent, run = parents[parent], parent
        i = list(parent).index(run)
        parent[i:i] = made

    def edited(self, a: ET.Element, b: ET.Element) -> None:
        """Mark the differences of two matched paragraphs."""
        self.renumbered(a, b)
        x, y = plain_text(a), plain_text(b)
        if x == y:
            return
        u, v = LEXERS["diff"].findall(x), LEXERS["diff"].findall(y)
        starts = lambda ts: [0, *accumulate(map(len, ts))]
        su, sv = starts(u), starts(v)
        gaps = compact_gaps(lcs_pairs(u, v), len(u), len(v))
        for _, p, q, r, s in reversed(gaps):  # from the end, so that places before stay
            if s > r:
                self.inserted(b, sv[r], sv[s])
            if q > p:
                self.put_back_before(b, sv[r], self.deleted_runs(a, su[p], su[q]))

    def put_back_before(self, p: ET.Element, at: int, made: list[ET.Element]) -> None:
        """put_back() that counts runs already marked as inserted, too."""
        done = 0
        for c in list(p):
            size = len(_visible(c))
            if done == at and (size or c.tag == f"{_W}ins"):
                i = list(p).index(c)
                p[i:i] = made
                return
            if done < at < done + size:
                if c.tag == f"{_W}r":
                    self.cut(p, at)
                    return self.put_back_before(p, at, made)
                return self.put_back_before(c, at - done, made)
            done += size
        p.extend(made)

    def renumbered(self, a: ET.Element, b: ET.Element) -> None:
        """A list number that is new, or was another one, is recorded in the new paragraph's."""
        labels = self.labels_old.get(a, ""), self.labels_new.get(b, "")
        number = b.find(f"{_W}pPr/{_W}numPr")
        if labels[0] == labels[1] or number is None or not labels[1]:
            return
        if labels[0]:
            change = self.mark("numberingChange")
            change.set(f"{_W}original", labels[0])
            number.append(change)
        else:
            number.append(self.mark("ins"))

    # ------------------------------------------------ whole paragraphs, rows, cells, tables

    def properties(self, p: ET.Element) -> ET.Element:
        pr = p.find(f"{_W}pPr")
        if pr is None:
            pr = ET.Element(f"{_W}pPr")
            p.insert(0, pr)
        return pr

    def mark_paragraph(self, p: ET.Element, tag: str) -> None:
        pr = self.properties(p)
        run = pr.find(f"{_W}rPr")
        if run is None:
            run = ET.Element(f"{_W}rPr")
            at = next((i for i, x in enumerate(pr) if x.tag in (f"{_W}sectPr", f"{_W}pPrChange")), len(pr))
            pr.insert(at, run)
        if run.find(f"{_W}{tag}") is None:
            run.insert(0, self.mark(tag))

    def new_paragraph(self, p: ET.Element) -> None:
        self.inserted(p, 0, len(plain_text(p)))
        self.mark_paragraph(p, "ins")

    def old_paragraph(self, p: ET.Element) -> ET.Element:
        out = ET.Element(p.tag)
        pr = p.find(f"{_W}pPr")
        if pr is not None:
            kept = copy.deepcopy(pr)
            for tag in ("sectPr", "pPrChange", "framePr"):
                for x in kept.findall(f"{_W}{tag}"):
                    kept.remove(x)
            number = kept.find(f"{_W}numPr")
            if number is not None:
                ident = number.find(f"{_W}numId")
                kept.remove(number)
                if ident is not None and ident.get(f"{_W}val") in self.new.numbering.instance:
                    at = next((i for i, x in enumerate(kept) if x.tag.removeprefix(_W) not in _BEFORE_NUMBER), len(kept))
                    kept.insert(at, number)
            out.append(kept)
        self.mark_paragraph(out, "del")
        out.extend(self.deleted_runs(p, 0, len(plain_text(p))))
        return out

    def mark_row(self, row: ET.Element, tag: str) -> None:
        pr = row.find(f"{_W}trPr")
        if pr is None:
            pr = ET.Element(f"{_W}trPr")
            row.insert(next((i + 1 for i, x in enumerate(row) if x.tag == f"{_W}tblPrEx"), 0), pr)
        if pr.find(f"{_W}{tag}") is None:
            pr.append(self.mark(tag))

    def new_row(self, row: ET.Element) -> None:
        self.mark_row(row, "ins")
        for cell, _ in _flow(row, ("tc",)):
            self.new_content(cell)

    def new_content(self, container: ET.Element) -> None:
        for e, _ in list(_flow(container)):
            if e.tag == f"{_W}p":
                self.new_paragraph(e)
            else:
                for row, _ in list(_flow(e, ("tr",))):
                    self.new_row(row)

    def old_row(self, row: ET.Element) -> ET.Element:
        out = ET.Element(row.tag)
        for x in row:
            if x.tag in (f"{_W}trPr", f"{_W}tblPrEx"):
                out.append(copy.deepcopy(x))
        out.extend(self.old_cell(c) for c, _ in _flow(row, ("tc",)))
        self.mark_row(out, "del")
        return out

    def old_cell(self, cell: ET.Element) -> ET.Element:
        out = ET.Element(cell.tag)
        if (pr := cell.find(f"{_W}tcPr")) is not None:
            out.append(copy.deepcopy(pr))
        out.extend(self.old_block(e) for e, _ in _flow(cell))
        if not len(out) or out[-1].tag != f"{_W}p":
            out.append(ET.Element(f"{_W}p"))
        return out

    def old_block(self, e: ET.Element) -> ET.Element:
        if e.tag == f"{_W}p":
            return self.old_paragraph(e)
        out = ET.Element(e.tag)
        out.extend(copy.deepcopy(x) for x in e if x.tag in (f"{_W}tblPr", f"{_W}tblGrid"))
        out.extend(self.old_row(r) for r, _ in _flow(e, ("tr",)))
        return out

    def placed(self, made: list[tuple[int, ET.Element]], place: dict[int, tuple[ET.Element, ET.Element]], n: int, container: ET.Element) -> None:
        """Put back old elements (index, element) after the new one that their
        predecessor maps to, else before that of their successor, else at the start."""
        last: dict[int, tuple] = {}
        for i, e in made:
            before = next((k for k in range(i - 1, -1, -1) if k in place), None)
            after = next((k for k in range(i + 1, n) if k in place), None)
            if before is not None:
                at, parent = last.get(before, place[before])
                parent.insert(list(parent).index(at) + 1, e)
                last[before] = (e, parent)
            elif after is not None:
                at, parent = place[after]
                parent.insert(list(parent).index(at), e)
            else:
                first = next((k for k, x in enumerate(container) if x.tag in (f"{_W}sectPr", f"{_W}p", f"{_W}tbl")), len(container))
                first += sum(1 for j, _ in made if j < i)
                container.insert(first, e)

    def blocks(self, old: ET.Element, new: ET.Element) -> None:
        """Mark the differences of two containers: bodies or cells."""
        a, b = list(_flow(old)), list(_flow(new))
        pa, pb = [i for i, (e, _) in enumerate(a) if e.tag == f"{_W}p"], [j for j, (e, _) in enumerate(b) if e.tag == f"{_W}p"]
        pairs = {pa[x]: pb[y] for x, y in paragraphs([match_key(plain_text(a[i][0])) for i in pa], [match_key(plain_text(b[j][0])) for j in pb])}
        ta, tb = [i for i in range(len(a)) if i not in pa], [j for j in range(len(b)) if j not in pb]
        table = lambda e: {"rows": [[run_text(c) for c, _ in _flow(r, ("tc",))] for r, _ in _flow(e, ("tr",))]}
        tables, rows = match_tables([table(a[i][0]) for i in ta], [table(b[j][0]) for j in tb])
        tables = {(x, y): (ta[x], tb[y]) for x, y, _ in tables}
        place = {i: b[j] for i, j in pairs.items()} | {i: b[j] for i, j in tables.values()}
        used = set(pairs.values()) | {j for _, j in tables.values()}
        for j, (e, _) in enumerate(b):
            if j not in used:
                if e.tag == f"{_W}p":
                    self.new_paragraph(e)
                else:
                    for row, _ in list(_flow(e, ("tr",))):
                        self.new_row(row)
        for i, j in pairs.items():
            self.edited(a[i][0], b[j][0])
        for key, (i, j) in tables.items():
            self.rows(a[i][0], b[j][0], dict(rows[key]))
        self.placed([(i, self.old_block(e)) for i, (e, _) in enumerate(a) if i not in place], place, len(a), new)

    def rows(self, old: ET.Element, new: ET.Element, pairs: dict[int, int]) -> None:
        a, b = list(_flow(old, ("tr",))), list(_flow(new, ("tr",)))
        for q, (row, _) in enumerate(b):
            if q not in pairs.values():
                self.new_row(row)
        for p, q in pairs.items():
            self.cells(a[p][0], b[q][0])
        self.placed([(p, self.old_row(r)) for p, (r, _) in enumerate(a) if p not in pairs], {p: b[q] for p, q in pairs.items()}, len(a), new)

    def cells(self, old: ET.Element, new: ET.Element) -> None:
        a, b = list(_flow(old, ("tc",))), list(_flow(new, ("tc",)))
        for (x, _), (y, _) in zip(a, b):
            self.blocks(x, y)
        for cell, _ in b[len(a) :]:
            self.mark_cell(cell, "cellIns")
            self.new_content(cell)
        made = []
        for k, (cell, _) in enumerate(a[len(b) :], len(b)):
            made.append((k, self.old_cell(cell)))
            self.mark_cell(made[-1][1], "cellDel")
        self.placed(made, dict(enumerate(b)), len(a), new)

    def mark_cell(self, cell: ET.Element, tag: str) -> None:
        pr = cell.find(f"{_W}tcPr")
        if pr is None:
            pr = ET.Element(f"{_W}tcPr")
            cell.insert(0, pr)
        if pr.find(f"{_W}{tag}") is None:
            pr.append(self.mark(tag))

    # ------------------------------------------------ the package

    def run(self) -> bytes:
        self.labels_old = {p: self.old.numbering.label(p) for p in self.old.body.iter(f"{_W}p")}
        self.labels_new = {p: self.new.numbering.label(p) for p in self.new.body.iter(f"{_W}p")}
        self.blocks(self.old.body, self.new.body)
        self.new.parts[MAIN] = serialized(self.new.root, self.new.parts[MAIN])
        self.styles()
        self.settings()
        return self.new.write()

    def styles(self) -> None:
        """Styles of the old package that put-back content uses and the new one lacks."""
        name = "word/styles.xml"
        if name not in self.old.parts or name not in self.new.parts:
            return
        old, new = ET.fromstring(self.old.parts[name]), ET.fromstring(self.new.parts[name])
        there = {s.get(f"{_W}styleId") for s in new.iter(f"{_W}style")}
        theirs = {s.get(f"{_W}styleId"): s for s in old.iter(f"{_W}style")}
        todo = [e.get(f"{_W}val") for e in self.new.root.iter() if e.tag in (f"{_W}pStyle", f"{_W}rStyle", f"{_W}tblStyle")]
        added = False
        while todo:
            ident = todo.pop()
            if ident in there or ident not in theirs:
                continue
            there.add(ident)
            style = copy.deepcopy(theirs[ident])
            style.attrib.pop(f"{_W}default", None)
            new.append(style)
            added = True
            todo += [x.get(f"{_W}val") for t in ("basedOn", "next", "link") for x in style.findall(f"{_W}{t}")]
        if added:
            self.new.parts[name] = serialized(new, self.new.parts[name])

    def settings(self) -> None:
        """The setting that goes on tracking, with its part, type and relationship."""
        name, rels, types = "word/settings.xml", "word/_rels/document.xml.rels", "[Content_Types].xml"
        space = _W[1:-1]
        source = self.new.parts.get(name, f'<w:settings xmlns:w="{space}"/>'.encode())
        root = ET.fromstring(source)
        if root.find(f"{_W}trackRevisions") is None:
            before = {f"{_W}{t}" for t in ("writeProtection", "view", "zoom", "removePersonalInformation", "removeDateAndTime", "doNotDisplayPageBoundaries", "displayBackgroundShape", "printPostScriptOverText", "printFractionalCharacterWidth", "printFormsData", "embedTrueTypeFonts", "embedSystemFonts", "saveSubsetFonts", "saveFormsData", "mirrorMargins", "alignBordersAndEdges", "bordersDoNotSurroundHeader", "bordersDoNotSurroundFooter", "gutterAtTop", "hideSpellingErrors", "hideGrammaticalErrors", "activeWritingStyle", "proofState", "formsDesign", "attachedTemplate", "linkStyles", "stylePaneFormatFilter", "stylePaneSortMethod", "documentType", "mailMerge", "revisionView")}
            root.insert(next((i for i, x in enumerate(root) if x.tag not in before), len(root)), ET.Element(f"{_W}trackRevisions"))
        self.new.parts[name] = serialized(root, source)
        source = self.new.parts.get(rels, f'<Relationships xmlns="{_REL}"/>'.encode())
        root = ET.fromstring(source)
        if not any(r.get("Type") == f"{_OFFICE}/settings" for r in root):
            used = {r.get("Id") for r in root}
            ident = next(f"rId{k}" for k in range(1, len(used) + 2) if f"rId{k}" not in used)
            ET.SubElement(root, f"{{{_REL}}}Relationship", {"Id": ident, "Type": f"{_OFFICE}/settings", "Target": "settings.xml"})
            self.new.parts[rels] = _plain(root, _REL)
        source = self.new.parts.get(types)
        if source is not None:
            root = ET.fromstring(source)
            if not any(r.get("PartName") == f"/{name}" for r in root):
                ET.SubElement(root, f"{{{_TYPES}}}Override", {"PartName": f"/{name}", "ContentType": "application/vnd.openxmlformats-officedocument.wordprocessingml.settings+xml"})
                self.new.parts[types] = _plain(root, _TYPES)


def _visible(e: ET.Element) -> str:
    """The text of an element of a paragraph as _runs() counts it, insertions included."""
    if e.tag == f"{_W}r":
        holder = ET.Element(f"{_W}p")
        holder.append(e)
        return plain_text(holder)
    return "".join(map(_visible, e)) if e.tag in _THROUGH or e.tag == f"{_W}ins" else ""


def _plain(root: ET.Element, space: str) -> bytes:
    """A part whose elements are all of one namespace, without a prefix."""
    ET.register_namespace("", space)
    text = ET.tostring(root, encoding="unicode")
    return ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n' + text).encode()


def tracked_package(old: bytes, new: bytes, author: str = "textloom", date: str = "2000-01-01T00:00:00Z") -> bytes:
    """The new package with tracked changes from the old one."""
    if tracks_changes(new) or tracks_changes(old):
        raise ValueError("the document tracks changes already")
    return Writer(Package(old), Package(new), author, date).run()


def resolved(raw: bytes, accept: bool) -> bytes:
    """The package with all its tracked changes accepted or rejected."""
    package = Package(raw)
    gone, kept = ("del", "ins") if accept else ("ins", "del")

    def walk(e):
        for c in list(e):
            row = c.find(f"{_W}trPr/{_W}{gone}") if c.tag == f"{_W}tr" else None
            cell = c.find(f"{_W}tcPr/{_W}cell{gone.title()}") if c.tag == f"{_W}tc" else None
            mark = c.find(f"{_W}pPr/{_W}rPr/{_W}{gone}") if c.tag == f"{_W}p" else None
            if c.tag == f"{_W}{gone}" or row is not None or cell is not None or mark is not None:
                e.remove(c)
            elif c.tag == f"{_W}{kept}" and e.tag not in (f"{_W}trPr", f"{_W}rPr", f"{_W}numPr"):
                i = list(e).index(c)
                walk(c)
                e[i : i + 1] = list(c)
            elif c.tag in (f"{_W}{kept}", f"{_W}cell{kept.title()}", f"{_W}numberingChange"):
                e.remove(c)
            else:
                walk(c)
                if c.tag == f"{_W}tbl" and not any(True for _ in _flow(c, ("tr",))):
                    e.remove(c)  # a table goes with its last row
        for c in e.iter(f"{_W}delText"):
            c.tag = f"{_W}t"

    walk(package.body)
    package.parts[MAIN] = serialized(package.root, package.parts[MAIN])
    return package.write()
