"""WordprocessingML (ECMA-376) as blocks: paragraphs and table cells.

One file is read by one call, since list numbers count in document order; files
are spread by their rows.
"""

from __future__ import annotations

import bisect
import io
import re
import zipfile
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import number_text
from ..functions.vectorized import vectorized
from ..storage import saved

MOST_XML, MOST_DEPTH = 128 << 20, 16
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_FALLBACK = "{http://schemas.openxmlformats.org/markup-compatibility/2006}Fallback"
_SEE_THROUGH = {f"{_W}{t}" for t in ("sdt", "sdtContent", "customXml", "smartTag", "ins", "moveTo", "hyperlink", "fldSimple")}


def xml_part(archive: zipfile.ZipFile, name: str) -> ET.Element | None:
    try:
        info = archive.getinfo(name)
    except KeyError:
        return None
    if info.file_size > MOST_XML:
        raise ValueError(f"{name} is larger than {MOST_XML} bytes")
    return ET.fromstring(archive.read(info))


def _children(e: ET.Element):
    """Children with content controls and the like seen through."""
    for c in e:
        if c.tag in _SEE_THROUGH:
            yield from _children(c)
        else:
            yield c


def _val(e: ET.Element | None, name: str = "val") -> str | None:
    return None if e is None else e.get(f"{_W}{name}")


def _level(v: ET.Element) -> dict:
    return {"start": int(_val(v.find(f"{_W}start")) or 1), "format": _val(v.find(f"{_W}numFmt")) or "decimal", "text": _val(v.find(f"{_W}lvlText")) or "", "restart": _val(v.find(f"{_W}lvlRestart"))}


class Numbering:
    """List levels, their instances and running counters."""

    def __init__(self, numbering: ET.Element | None, styles: ET.Element | None):
        self.abstract, self.instance, self.style, self.count = {}, {}, {}, {}
        for a in numbering.iter(f"{_W}abstractNum") if numbering is not None else ():
            self.abstract[_val(a, "abstractNumId")] = {int(_val(v, "ilvl") or 0): _level(v) for v in a.iter(f"{_W}lvl")}
        for n in numbering.iter(f"{_W}num") if numbering is not None else ():
            starts = {int(_val(o, "ilvl") or 0): int(s) for o in n.iter(f"{_W}lvlOverride") if (s := _val(o.find(f"{_W}startOverride")))}
            levels = {int(_val(o, "ilvl") or 0): _level(v) for o in n.iter(f"{_W}lvlOverride") if (v := o.find(f"{_W}lvl")) is not None}
            self.instance[_val(n, "numId")] = (_val(n.find(f"{_W}abstractNumId")), starts, levels)
        for s in styles.iter(f"{_W}style") if styles is not None else ():
            self.style[_val(s, "styleId")] = (s.find(f"{_W}pPr"), _val(s.find(f"{_W}basedOn")))

    def reference(self, p: ET.Element) -> tuple[str, int] | None:
        """(instance, level) of a paragraph, its own or its style chain's."""
        pr, seen = p.find(f"{_W}pPr"), set()
        style = _val(pr.find(f"{_W}pStyle")) if pr is not None else None
        while True:
            num = pr.find(f"{_W}numPr") if pr is not None else None
            if num is not None and _val(num.find(f"{_W}numId")) is not None:
                ident = _val(num.find(f"{_W}numId"))
                return None if ident == "0" else (ident, int(_val(num.find(f"{_W}ilvl")) or 0))
            if style is None or style in seen or style not in self.style:
                return None
            seen.add(style)
            pr, style = self.style[style]

    def label(self, p: ET.Element) -> str:
        ref = self.reference(p)
        if not ref or ref[0] not in self.instance:
            return ""
        ident, level = ref
        abstract, starts, own = self.instance[ident]
        levels = self.abstract.get(abstract, {}) | own
        if level not in levels:
            return ""
        count = self.count.setdefault(ident, {})
        count[level] = count.get(level, starts.get(level, levels[level]["start"]) - 1) + 1
        for deeper in [k for k in count if k > level and levels.get(k, {}).get("restart") != "0"]:
            del count[deeper]
        if levels[level]["format"] in ("bullet", "none"):
            return levels[level]["text"] if levels[level]["format"] == "bullet" else ""

        def shown(m):
            k = int(m.group(1)) - 1
            return number_text(count.get(k, levels.get(k, {}).get("start", 1)), levels.get(k, {}).get("format", "decimal"))

        return re.sub(r"%(\d)", shown, levels[level]["text"])


def run_text(p: ET.Element) -> str:
    """Visible text of a paragraph: no deleted, moved-away or hidden runs, each
    text box once."""
    out = []

    def walk(e):
        for c in e:
            if c.tag in (f"{_W}del", f"{_W}moveFrom", f"{_W}pPr", f"{_W}txbxContent"):
                continue
            if c.tag == f"{_W}r":
                hidden = c.find(f"{_W}rPr/{_W}vanish")
                if hidden is None or _val(hidden) in ("0", "false"):
                    run(c)
            elif c.tag.endswith("}Fallback"):
                continue
            else:
                walk(c)

    def run(r):
        for c in r:
            if c.tag == f"{_W}t":
                out.append(c.text or "")
            elif c.tag == f"{_W}tab":
                out.append("\t")
            elif c.tag in (f"{_W}br", f"{_W}cr"):
                out.append("\n")
            elif c.tag == f"{_W}noBreakHyphen":
                out.append("‑")
            elif not c.tag.endswith("}Fallback"):
                walk(c)

    walk(p)
    return "".join(out)


def blocks(raw: bytes) -> list[tuple]:
    """(text, table, row, column, span, vmerge, parent_table, parent_row,
    parent_column, paragraphs) of a document; table is null for paragraphs."""
    with zipfile.ZipFile(io.BytesIO(bytes(raw))) as z:
        body = xml_part(z, "word/document.xml")
        numbering = Numbering(xml_part(z, "word/numbering.xml"), xml_part(z, "word/styles.xml"))
    if body is None:
        raise ValueError("no main document part")
    out, tables = [], [0]

    def paragraph(p):
        label, text = numbering.label(p), run_text(p)
        return f"{label} {text}" if label and text.strip() and not text.lstrip().startswith(label) else text

    def boxes(e):
        """Paragraphs of text boxes; a box's fallback for older readers repeats it."""
        for x in e:
            if x.tag == f"{_W}txbxContent":
                yield from (paragraph(q) for q in x.iter(f"{_W}p"))
            elif x.tag != _FALLBACK:
                yield from boxes(x)

    def table(t, parent, depth):
        if depth > MOST_DEPTH:
            raise ValueError("tables nest too deep")
        me = tables[0]
        tables[0] += 1
        for r, row in enumerate(x for x in _children(t) if x.tag == f"{_W}tr"):
            column = 0
            for cell in (x for x in _children(row) if x.tag == f"{_W}tc"):
                pr = cell.find(f"{_W}tcPr")
                span = int(_val(pr.find(f"{_W}gridSpan")) or 1) if pr is not None else 1
                merge = pr.find(f"{_W}vMerge") if pr is not None else None
                state = "none" if merge is None else (_val(merge) or "continue")
                texts, nested = [], []
                for x in _children(cell):
                    if x.tag == f"{_W}p":
                        texts.append(paragraph(x))
                    elif x.tag == f"{_W}tbl":
                        nested.append(x)
                out.append(("\n".join(texts), me, r, column, span, state, *parent, len(texts)))
                for x in nested:
                    table(x, (me, r, column), depth + 1)
                column += span

    def flow(e):
        for x in _children(e):
            if x.tag == f"{_W}p":
                text = paragraph(x)
                if text.strip():
                    out.append((text, None, None, None, None, None, None, None, None, 1))
                out.extend((t, None, None, None, None, None, None, None, None, 1) for t in boxes(x) if t.strip())
            elif x.tag == f"{_W}tbl":
                table(x, (None, None, None), 1)

    flow(body.find(f"{_W}body"))
    return out


def flat_text(raw: bytes) -> str:
    """Paragraphs as lines, the cells of a table row joined by a bar."""
    lines, row, key = [], [], None
    for text, *cell in blocks(raw):
        if cell[0] is None:
            here = None
        else:
            here = (cell[0], cell[1])
        if here != key and row:
            lines.append(" | ".join(row))
            row = []
        key = here
        if here is None:
            lines.append(text)
        else:
            row.append(text.replace("\n", " "))
    if row:
        lines.append(" | ".join(row))
    return "\n".join(lines)


BLOCK = "array<struct<text:string,table:int,row:int,col:int,span:int,vmerge:string,parent_table:int,parent_row:int,parent_col:int,n_par:int>>"
blocks_col = vectorized(blocks, BLOCK)
flat_text_col = vectorized(flat_text, "string")


class Formats:
    """The formatting of paragraphs and runs: defaults, style chains, own properties,
    the last of which wins."""

    def __init__(self, styles: ET.Element | None):
        self.chain = {_val(s, "styleId"): s for s in styles.iter(f"{_W}style")} if styles is not None else {}
        defaults = styles.find(f"{_W}docDefaults") if styles is not None else None
        self.defaults = [x for x in defaults.iter() if x.tag.endswith("PrDefault")] if defaults is not None else []

    def layers(self, name: str | None) -> list[ET.Element]:
        """A style and those that it is based on, the nearest first."""
        out, seen = [], set()
        while name in self.chain and name not in seen:
            seen.add(name)
            out.append(self.chain[name])
            name = _val(self.chain[name].find(f"{_W}basedOn"))
        return out

    def of(self, p: ET.Element, run: ET.Element | None) -> tuple:
        """(style, bold, italic, underline, strike, size, colour, font, left, hanging)."""
        pr = p.find(f"{_W}pPr")
        name = _val(pr.find(f"{_W}pStyle")) if pr is not None else None
        own = run.find(f"{_W}rPr") if run is not None else None
        by_run = self.layers(_val(own.find(f"{_W}rStyle")) if own is not None else None)
        layers = self.layers(name) + self.defaults
        runs = [own] + [x.find(f"{_W}rPr") for x in by_run + layers]
        paras = [pr] + [x.find(f"{_W}pPr") for x in layers]
        first = lambda ls, tag: next((x for e in ls if e is not None and (x := e.find(f"{_W}{tag}")) is not None), None)
        on = lambda e: e is not None and _val(e) not in ("0", "false", "none")
        ind = first(paras, "ind")
        return (name, *(on(first(runs, t)) for t in ("b", "i", "u", "strike")), _val(first(runs, "sz")), _val(first(runs, "color")), _val(first(runs, "rFonts"), "ascii"), _val(ind, "left"), _val(ind, "hanging"))


def _parts(raw: bytes) -> tuple[ET.Element, ET.Element | None]:
    with zipfile.ZipFile(io.BytesIO(bytes(raw))) as z:
        return xml_part(z, "word/document.xml"), xml_part(z, "word/styles.xml")


def _styles(raw: bytes) -> list[tuple]:
    """(ordinal, text, style, bold, italic, underline, strike, size, colour, font,
    left, hanging) of paragraphs, with the formatting of their first run."""
    body, styles = _parts(raw)
    formats = Formats(styles)
    return [(i, run_text(p), *formats.of(p, p.find(f"{_W}r"))) for i, p in enumerate(body.iter(f"{_W}p"))]


def _run_styles(raw: bytes) -> list[tuple]:
    """The same of runs with a text: (paragraph, ordinal in it, text, style, …)."""
    body, styles = _parts(raw)
    formats, out = Formats(styles), []
    for i, p in enumerate(body.iter(f"{_W}p")):
        n = 0
        for r in p.iter(f"{_W}r"):
            text = "".join(t.text or "" for t in r.findall(f"{_W}t"))
            if text:
                out.append((i, n, text, *formats.of(p, r)))
                n += 1
    return out


def _named_styles(raw: bytes) -> list[tuple[str, str, str]]:
    """(id, kind, definition) of named styles, attributes in order, ids of saves left out."""
    _, styles = _parts(raw)

    def shown(e):
        kept = sorted((k.removeprefix(_W), v) for k, v in e.attrib.items() if not k.removeprefix(_W).startswith("rsid"))
        return f"<{e.tag.removeprefix(_W)}{''.join(f' {k}={v!r}' for k, v in kept)}>{''.join(shown(c) for c in e if not c.tag.endswith('}rsid'))}</>"

    return [(_val(s, "styleId") or "", _val(s, "type") or "paragraph", "".join(map(shown, s))) for s in styles.iter(f"{_W}style")] if styles is not None else []


STYLE = "array<struct<ordinal:int,text:string,style:string,bold:boolean,italic:boolean,underline:boolean,strike:boolean,half_points:string,colour:string,font:string,left:string,hanging:string>>"
styles_col = vectorized(_styles, STYLE)
run_styles_col = vectorized(_run_styles, STYLE.replace("ordinal:int", "paragraph:int,ordinal:int"))
named_styles_col = vectorized(_named_styles, "array<struct<id:string,kind:string,definition:string>>")


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """(path, block_ix, text, table, row, col, …) of the .docx files under a path; a
    file over 40 MiB is an error, as is one that is no package."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.docx").load(path)
    fit = F.when(F.col("length") > 40 << 20, F.raise_error(F.concat(F.col("path"), F.lit(" is larger than 40 MiB")))).otherwise(F.col("length"))
    return files.where(fit >= 0).select("path", F.posexplode(blocks_col("content")).alias("block_ix", "b")).select("path", "block_ix", "b.*")


_PROPERTIES = ("style", "bold", "italic", "underline", "strike", "half_points", "colour", "font", "left", "hanging")


def nearest_free(old: list[int], new: list[int]) -> list[tuple[int, int]]:
    """(old, new) places of equal texts: each new one, in order, takes the nearest old
    one that is free, of two equally near the earlier. Both lists ascend.

    Taken places form runs; each place leads to the next free one on either side."""
    below, above = list(range(len(old) + 1)), list(range(len(old) + 1))  # by place + 1 and by place; 0 and len(old): none

    def find(to: list[int], i: int) -> int:
        while to[i] != i:
            to[i] = to[to[i]]
            i = to[i]
        return i

    out = []
    for n in new:
        at = bisect.bisect_left(old, n)
        i, j = find(below, at) - 1, find(above, at)
        if i < 0 and j == len(old):
            continue
        k = j if i < 0 or (j < len(old) and old[j] - n < n - old[i]) else i
        below[k + 1], above[k] = k, k + 1
        out.append((old[k], n))
    return out


_nearest_col = vectorized(lambda old, new: nearest_free([int(x) for x in old], [int(x) for x in new]), "array<struct<old:int,new:int>>")


def nearest_equal(before: DataFrame, after: DataFrame, keys: tuple[str, ...], text: str, order: str) -> DataFrame:
    """(keys, old_order, new_order) of rows with equal text: each row of after, in
    order, meets the row of before that is free and nearest by its number among the rows of its keys.

    Texts that are there once on both sides, nearly all, need no more than the join; the
    places of others are matched a text at a time (a document's, so bounded)."""
    k = list(keys)
    w = Window.partitionBy(*k).orderBy(order)
    side = lambda d, name: d.withColumn("at", F.row_number().over(w)).groupBy(*k, F.sha2(text, 256).alias("h")).agg(F.array_sort(F.collect_list(F.struct("at", order))).alias(name))
    met = saved(side(before, "x").join(side(after, "y"), [*k, "h"]))
    single = (F.size("x") == 1) & (F.size("y") == 1)
    one = met.where(single).select(*k, F.col("x")[0][order].alias("old_order"), F.col("y")[0][order].alias("new_order"))
    several = met.where(~single).withColumn("pair", F.explode(_nearest_col(F.transform("x", lambda r: r["at"]), F.transform("y", lambda r: r["at"]))))
    found = lambda side, at: F.filter(side, lambda r: r["at"] == at)[0][order]
    return one.unionByName(several.select(*k, found("x", F.col("pair.old")).alias("old_order"), found("y", F.col("pair.new")).alias("new_order")))


def formatting_changes(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, text, ordinal, old, new) of paragraphs of equal text (the nearest free one)
    whose properties differ; before and after are (keys, struct of styles_col)."""
    props = F.to_json(F.struct(*_PROPERTIES))
    side = lambda d, n: d.select(*keys, F.explode("styles").alias("s")).select(*keys, "s.*").where("text <> ''").select(*keys, "text", "ordinal", props.alias(n))
    x, y = side(before, "old"), side(after, "new")
    pairs = nearest_equal(x, y, keys, "text", "ordinal")
    met = pairs.join(x.select(*keys, F.col("ordinal").alias("old_order"), "old"), [*keys, "old_order"]).join(y.withColumnRenamed("ordinal", "new_order"), [*keys, "new_order"])
    return met.where("old <> new").select(*keys, "text", F.col("new_order").alias("ordinal"), "old", "new")


def run_changes(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, text, paragraph, old, new): runs whose text, at the same count of it in the
    paragraph that its own one meets (by nearest_equal), has other properties; before and
    after are (keys, runs of run_styles_col)."""
    props = F.to_json(F.struct(*_PROPERTIES))
    side = lambda d, n: d.select(*keys, F.explode("runs").alias("s")).select(*keys, "s.*").select(*keys, "paragraph", "ordinal", "text", props.alias(n))
    x, y = side(before, "old"), side(after, "new")
    whole = lambda d: d.groupBy(*keys, "paragraph").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda r: r["text"]), "").alias("text"))
    pairs = nearest_equal(whole(x), whole(y), keys, "text", "paragraph")
    nth = F.row_number().over(Window.partitionBy(*keys, "paragraph", F.sha2("text", 256)).orderBy("ordinal"))
    old = x.withColumn("nth", nth).select(*keys, F.col("paragraph").alias("old_order"), "text", "nth", "old")
    new = y.withColumn("nth", nth).select(*keys, F.col("paragraph").alias("new_order"), "text", "nth", "new")
    met = new.join(pairs, [*keys, "new_order"]).join(old, [*keys, "old_order", "text", "nth"])
    return met.where("old <> new").select(*keys, "text", F.col("new_order").alias("paragraph"), "old", "new")


def style_changes(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = ("doc_id",), content: str = "content") -> DataFrame:
    """(keys, id, change): named styles that are new, gone or defined otherwise."""
    side = lambda d, n: d.select(*keys, F.explode(named_styles_col(F.col(content))).alias("s")).select(*keys, "s.id", F.struct("s.kind", "s.definition").alias(n))
    both = side(before, "old").join(side(after, "new"), [*keys, "id"], "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").otherwise("modified")
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).select(*keys, "id", change.alias("change"))


def table_format_changes(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = ("doc_id",), content: str = "content") -> DataFrame:
    """(keys, table, change): tables, by their place, whose widths, spans or fills differ."""
    from .package import table_geometry_col

    def side(d, n):
        cells = d.select(*keys, F.explode(table_geometry_col(F.col(content))).alias("c"))
        return cells.groupBy(*keys, F.col("c.table").alias("table")).agg(F.array_sort(F.collect_list(F.struct("c.row", "c.column", "c.span", "c.width", "c.grid", "c.fill"))).alias(n))

    both = side(before, "old").join(side(after, "new"), [*keys, "table"], "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").otherwise("modified")
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).select(*keys, "table", change.alias("change"))
