"""Whether the content of a package that tracked text cannot carry is that of another:
fields, symbols, breaks, hyphens, links, bookmarks, note marks and drawings.

Readers give rows: a paragraph with its text, and a special with its paragraph, its
place among its elements, and the text ahead of it and behind it. What follows are
windows and joins. Specials of two documents meet by family and order. They are the
same if their values are, and if either their paragraph is the same (same text and
number among equal texts, or the same nearest other paragraph at the same distance)
and they stand between the same words in it, or the paragraph was edited and what
surrounds it shows that they stayed: a paragraph nearby that both have, one text in
the other, and a word beside the special that did not change. What moved within a
paragraph that did not change is told as moved, and so is a drawing whose paragraph
changed: text revisions could not move it.

Each distinct package is read once and each distinct pair compared once, whatever
number of rows has it.

Defined cases: null packages take no part; packages without specials are the same;
repeated rows are told alike; other columns don't matter.
"""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree as ET

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import LEXERS, match_key, match_key_col
from ..functions.vectorized import vectorized
from ..storage import saved
from .docx import _W, _val, xml_part
from .package import _R, MAIN, _payload, _relationships, _special

#: Neighbouring paragraphs that tell where one stands.
REACH = 8
_ANCHORS = {f"{_W}{n}" for n in ("hyperlink", "drawing", "object", "pict", "fldSimple")}
_HIDDEN = {f"{_W}{n}" for n in ("del", "moveFrom", "pPr", "txbxContent")}
_SHOWN = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n", f"{_W}noBreakHyphen": "-"}


def _walk(p: ET.Element) -> tuple[str, list[tuple[ET.Element, tuple, str, int, int]]]:
    """The visible text of a paragraph, and of each element in it: its ancestors,
    its path, and where in that text it starts and ends."""
    text, found = [], []
    size = 0

    def down(e: ET.Element, above: tuple, path: str, shown: bool, in_run: bool) -> None:
        nonlocal size
        for i, c in enumerate(e):
            tag = c.tag
            visible = shown and tag not in _HIDDEN and not tag.endswith("}Fallback")
            if tag == f"{_W}r":
                off = c.find(f"{_W}rPr/{_W}vanish")
                visible = visible and (off is None or _val(off) in ("0", "false"))
            at, start = len(found), size
            here = f"{path}/{tag.rsplit('}', 1)[-1]}#{i}"
            found.append((c, above, here, start, start))
            if visible and in_run:
                said = (c.text or "") if tag == f"{_W}t" else _SHOWN.get(tag, "")
                text.append(said)
                size += len(said)
            down(c, (*above, c), here, visible, in_run or tag == f"{_W}r")
            found[at] = (c, above, here, start, size)

    down(p, (), "", True, False)
    return "".join(text), found


def _other(e: ET.Element, linked: set) -> tuple[str, str] | None:
    """(kind, value) of an element that is special by itself."""
    if e.tag == f"{_W}hyperlink":
        named = [_val(e, n) or "" for n in ("anchor", "docLocation", "tgtFrame", "tooltip")]
        return ("link", "|".join(named)) if any(named) else None
    if e.tag in (f"{_W}commentRangeStart", f"{_W}commentRangeEnd"):
        return "comment", f"{e.tag.rsplit('}', 1)[-1]}|{_val(e, 'id') or ''}"
    found = _special(e)
    if found is None or (found[0] == "bookmark" and found[1] not in linked) or (found[0] == "field" and not match_key(found[1])):
        return None
    return (found[0], match_key(found[1]) if found[0] == "field" else found[1])


def read(raw: bytes) -> tuple[list[tuple], list[tuple]]:
    """(paragraphs, specials): texts of paragraphs in order, and (paragraph, family,
    kind, value, path, anchor, anchored, ahead, behind) of specials in order."""
    texts, specials = [], []
    with zipfile.ZipFile(io.BytesIO(bytes(raw))) as z:
        relations, body = _relationships(z, MAIN), xml_part(z, MAIN)
        linked = {_val(h, "anchor") for h in body.iter(f"{_W}hyperlink")}
        for n, p in enumerate(body.iter(f"{_W}p")):
            text, found = _walk(p)
            texts.append(text)
            inner = {id(x) for q in p.iter(f"{_W}p") if q is not p for x in q.iter()}  # a text box has paragraphs of its own
            places = {id(e): (path, start, end) for e, _, path, start, end in found}
            for e, above, path, start, end in found:
                if id(e) in inner or e.tag in (f"{_W}headerReference", f"{_W}footerReference"):
                    continue
                for name in sorted(k for k in e.attrib if k.startswith(_R)):
                    anchor = next((a for a in (e, *reversed(above)) if a.tag in _ANCHORS), e)
                    where, a, b = places[id(anchor)]
                    value = f"{e.tag.rsplit('}', 1)[-1]}|{name.removeprefix(_R)}|{_payload(z, relations.get(e.get(name)))}"
                    specials.append((n, "relation", anchor.tag.rsplit("}", 1)[-1], value, where, text[a:b], text[:a], text[b:]))
                other = _other(e, linked)
                if other:
                    specials.append((n, "inline", *other, path, text[start:end], text[:start], text[end:]))
    return texts, specials


_SPECIAL = "struct<paragraph:int,family:string,kind:string,value:string,path:string,anchor:string,ahead:string,behind:string>"
_texts_col = vectorized(lambda raw: read(raw)[0], "array<string>")
_specials_col = vectorized(lambda raw: read(raw)[1], f"array<{_SPECIAL}>")


def specials(packages: DataFrame, key: str = "doc", content: str = "content") -> DataFrame:
    """(key, family, ordinal, kind, value, path, anchor, nth_anchor, owner, nth, outside,
    before, after, left, right) of each special of each package (one row a key).

    owner is the paragraph's text and nth its number among equal ones, before and
    after the texts of REACH neighbours, nearest first, left and right the words beside it."""
    got = packages.where(F.col(content).isNotNull())
    plain = got.select(key, F.posexplode(_texts_col(F.col(content))).alias("paragraph", "text")).select(key, "paragraph", match_key_col(F.col("text")).alias("owner"))
    w = Window.partitionBy(key).orderBy("paragraph")
    near = F.collect_list("owner")
    # Equal texts are numbered by their hash: no text is a key.
    nth = F.row_number().over(Window.partitionBy(key, F.xxhash64("owner")).orderBy("paragraph"))
    told = plain.select(key, "paragraph", "owner", nth.alias("nth"), F.reverse(near.over(w.rowsBetween(-REACH, -1))).alias("before"), near.over(w.rowsBetween(1, REACH)).alias("after"))
    each = got.select(key, F.posexplode(_specials_col(F.col(content))).alias("place", "s")).select(key, "place", "s.*")
    each = each.withColumn("ordinal", F.row_number().over(Window.partitionBy(key, "family").orderBy("place")))
    words = lambda c: F.regexp_extract_all(c, F.lit("(?U)" + LEXERS["boundary"].pattern), F.lit(0))
    anchor, ahead, behind = (match_key_col(F.col(c)) for c in ("anchor", "ahead", "behind"))
    each = each.withColumns({"anchor": anchor, "ahead": ahead, "left": F.coalesce(F.try_element_at(words(ahead), F.lit(-1)), F.lit("")), "right": F.coalesce(F.try_element_at(words(behind), F.lit(1)), F.lit(""))})
    a, o = F.col("anchor"), F.col("owner")
    nth_anchor = F.when(a == "", 0).otherwise((F.length("ahead") - F.length(F.replace("ahead", a))) / F.length(a)).cast("int")
    at = F.instr(o, a)
    outside = F.when((a == "") | (at == 0), o).otherwise(F.concat(F.substring(o, F.lit(1), at - 1), F.substring(o, at + F.length(a), F.length(o))))
    return each.join(told, [key, "paragraph"]).select(key, "family", "ordinal", "kind", "value", "path", "anchor", nth_anchor.alias("nth_anchor"), "owner", "nth", outside.alias("outside"), "before", "after", "left", "right")


def _same(x: str, y: str) -> Column:
    """Whether the special with the columns x.* stayed where y.* is, by the rule above."""
    c = lambda name: (F.col(f"{x}.{name}"), F.col(f"{y}.{name}"))
    eq = lambda name: c(name)[0] == c(name)[1]
    some = lambda s: s != ""

    def nearest(side: str, name: str) -> Column:
        texts, owner = F.col(f"{side}.{name}"), F.col(f"{side}.owner")
        first = F.array_position(F.transform(texts, lambda t: some(t) & (t != owner)), True)
        return F.when(first > 0, F.struct(first.alias("far"), F.get(texts, (first - 1).cast("int")).alias("text")))

    alike = lambda name: F.coalesce(nearest(x, name) == nearest(y, name), F.lit(False))
    overlap = lambda name: F.coalesce(F.arrays_overlap(*(F.filter(s, some) for s in c(name))), F.lit(False))
    alone = F.lit(True)
    for s in (*c("before"), *c("after")):
        alone = alone & (F.size(s) == 0)
    context = overlap("before") | overlap("after") | alone
    owner = eq("owner") & ((some(c("owner")[0]) & eq("nth")) | alike("before") | alike("after"))
    immediate = F.get(c("before")[0], 0).eqNullSafe(F.get(c("before")[1], 0)) & F.get(c("after")[0], 0).eqNullSafe(F.get(c("after")[1], 0))
    anchored = some(c("anchor")[0]) & eq("anchor") & eq("nth_anchor")
    within = lambda a, b: a.contains(b) | b.contains(a)
    linked = context & ((eq("path") & eq("outside")) | (anchored & within(*c("outside"))))
    relation = F.when(owner, F.when(c("kind")[0] == "hyperlink", anchored).otherwise(eq("path"))).otherwise((c("kind")[0] == "hyperlink") & linked)
    stable = (some(c("left")[0]) & eq("left")) | (some(c("right")[0]) & eq("right"))
    held = some(c("owner")[0]) & some(c("owner")[1]) & within(*c("owner"))
    marks = c("kind")[0].isin("link", "bookmark", "comment", "commentReference")
    inline = (
        F.when(c("kind")[0].isin("softHyphen", "noBreakHyphen") & eq("path"), True)
        .when(owner, F.when(c("owner")[0] == "", eq("path")).otherwise(eq("left") & eq("right")))
        .when(eq("owner"), False).when(eq("path") & marks & immediate, True).otherwise(context & held & stable)
    )
    return eq("kind") & eq("value") & F.when(c("family")[0] == "relation", relation).otherwise(inline)


def special_changes(pairs: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """(old, new, family, ordinal, kind, value, change) of the specials of pairs of
    packages (by the hashes of old and new) that are not the same: added, deleted or moved."""
    hashes = [F.sha2(F.col(c), 256) for c in (old, new)]
    both = pairs.where(F.col(old).isNotNull() & F.col(new).isNotNull()).select(hashes[0].alias("old"), hashes[1].alias("new")).where("old <> new").distinct()
    held = [pairs.where(F.col(c).isNotNull()).select(h.alias("doc"), F.col(c).alias("content")) for c, h in zip((old, new), hashes)]
    found = saved(specials(held[0].unionByName(held[1]).dropDuplicates(["doc"])))
    side = lambda name: both.join(found, F.col(name) == F.col("doc")).select("old", "new", "family", "ordinal", F.struct(*[c for c in found.columns if c != "doc"]).alias("x" if name == "old" else "y"))
    met = side("old").join(side("new"), ["old", "new", "family", "ordinal"], "full")
    change = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "deleted").when((F.col("x.kind") != F.col("y.kind")) | (F.col("x.value") != F.col("y.value")), "replaced").when(~_same("x", "y"), "moved")
    return met.withColumn("change", change).where("change IS NOT NULL").select("old", "new", "family", "ordinal", F.coalesce("x.kind", "y.kind").alias("kind"), F.coalesce("x.value", "y.value").alias("value"), "change")
