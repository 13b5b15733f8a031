"""Comparison of two documents in one call: blocks to units, units to pairs, pairs
to numbered and placed change markers.

A pair of units is one row; its markers and typed structural messages come from
one kernel, so pairs are spread by their rows and a document is never one task's
work beyond the alignment of its units.
"""

from __future__ import annotations

import re
from collections import namedtuple
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import part_score
from ..functions.text import LEXERS, families, label_ordinal, lineage_key, match_key, utf16_len, visible_key
from ..functions.vectorized import arrowed, vectorized
from ..storage import saved, spread
from . import review
from .align import match_units
from .diff import review_events, whole_rewrite
from .parts import Item, match_parts
from .structure import header_spans, hierarchy, parts, units

#: A unit of a document; cells have table, row and col, their span and merge state, and their number of paragraphs.
FIELDS = ("unit_ix", "kind", "number", "title", "header", "body", "section", "table", "row", "col", "span", "vmerge", "n_par")
Unit = namedtuple("Unit", FIELDS, defaults=(None,) * len(FIELDS))
_UNIT = "unit_ix:int,kind:string,number:string,title:string,header:string,body:string,section:string,table:int,row:int,col:int,span:int,vmerge:string,n_par:int"
UNITS = f"array<struct<{_UNIT}>>"


def block_units(blocks: list, mode: str = "auto") -> list[tuple]:
    """Units of a document's blocks (text, table, row, col, span, vmerge, ...):
    runs of paragraphs by the grammar of texts, each cell a unit of its own. The
    mode of a document is that of all its paragraphs together."""
    get = lambda b, n, i: b[n] if isinstance(b, dict) else getattr(b, n) if hasattr(b, n) else b[i]
    prose = [get(b, "text", 0) or "" for b in blocks if get(b, "table", 1) is None]
    if mode == "auto":
        mode = "legal" if any(u[0] == "article" for u in units("\n".join(prose), "auto")) else "general"
    out, held = [], []

    def close():
        out.extend((*u, *[None] * 6) for u in units("\n".join(held), mode))
        held.clear()

    for b in blocks:
        text, table, row, col, span, vmerge, n_par = (get(b, n, i) for n, i in (("text", 0), ("table", 1), ("row", 2), ("col", 3), ("span", 4), ("vmerge", 5), ("n_par", 9)))
        if table is None:
            held.append(text or "")
        else:
            close()
            out.append(("cell", "", "", f"[{int(table) + 1}:{int(row) + 1}:{int(col) + 1}]", text or "", "", int(table), int(row), int(col), int(span), vmerge, int(n_par)))
    close()
    return [(i, *u) for i, u in enumerate(out)]


def text_units(text: str, mode: str = "auto") -> list[tuple]:
    """The units of a plain text."""
    return [(i, *u, *[None] * 6) for i, u in enumerate(units(text, mode))]


block_units_col = vectorized(lambda blocks: block_units(list(blocks)), UNITS)
text_units_col = arrowed(lambda text: text_units(text), UNITS)


# ---------------------------------------------------------------- one pair


def _summary(labels: list[str]) -> str:
    shown = [x for x in labels if x]
    return ", ".join(shown) if len(shown) <= 5 else f"{shown[0]} - {shown[-1]} ({len(shown)})"


def _parsed(body: str):
    found = parts(body)
    labels = [p[0] for p in found]
    kinds = families(labels)
    tree = hierarchy(labels, kinds)
    items = [Item(p[0], k, label_ordinal(p[0]) if p[0] else None, level, parent, p[5]) for p, k, (level, parent) in zip(found, kinds, tree)]
    return found, items


def _body_markers(old: str, new: str, base: tuple[int, int], punctuation: bool):
    """(markers, messages) of two bodies by their list items."""
    (fa, a), (fb, b) = _parsed(old), _parsed(new)
    markers, messages = [], []
    pairs = match_parts(a, b, scored=False)
    shapes = [[(x.level, x.parent, x.family) for x in s] for s in (a, b)]
    if shapes[0] != shapes[1] and any(x.label for x in a) and any(x.label for x in b):
        messages.append(("structure", _summary([x.label for x in a]), _summary([x.label for x in b])))
    for i, j, _ in pairs:
        (label_a, start_a, _, core_a, end_a, text_a), (label_b, start_b, _, core_b, end_b, text_b) = fa[i], fb[j]
        if label_a != label_b:
            markers.append(("label", "body", j, -2, base[0] + start_a, base[0] + start_a + utf16_len(label_a), base[1] + start_b, base[1] + start_b + utf16_len(label_b), label_a, label_b))
            same = a[i].ordinal is not None and a[i].ordinal == b[j].ordinal
            messages.append(("item level" if a[i].level != b[j].level else "item notation" if same else "item moved", label_a, label_b))
        if text_a == text_b or visible_key(text_a) == visible_key(text_b) and "".join(text_a.split()) == "".join(text_b.split()) and text_a.strip() == text_b.strip():
            continue
        if len(a) == len(b) == 1 and not label_a and not label_b:
            shown = match_key(text_a), match_key(text_b)
            # A score of 0 passes where any does: long texts and those of an equal edge are not scored.
            if whole_rewrite(*shown, 0.0, 1) and whole_rewrite(*shown, _plain_score(text_a, text_b), 1):
                markers.append(("change", "body", j, 0, base[0] + core_a, base[0] + end_a, base[1] + core_b, base[1] + end_b, text_a, text_b))
                continue
        for n, (kind, p, q, r, s, x, y) in enumerate(review_events(text_a, text_b, punctuation)):
            markers.append(("change" if kind == "space" else kind, "body", j, n, base[0] + core_a + p, base[0] + core_a + q, base[1] + core_b + r, base[1] + core_b + s, x, y))
    used = {j for _, j, _ in pairs}
    place = {i: j for i, j, _ in pairs}
    for i, p in enumerate(fa):
        if i not in place:
            after = next((fb[place[k]][2] for k in range(i - 1, -1, -1) if k in place), 0)
            text = _cut(old, p[1], p[2]).rstrip()
            markers.append(("delete", "body", next((place[k] for k in range(i - 1, -1, -1) if k in place), -1), 10_000 + i, base[0] + p[1], base[0] + p[1] + utf16_len(text), base[1] + after, base[1] + after, text, ""))
    back = {j: i for i, j, _ in pairs}
    for j, p in enumerate(fb):
        if j not in used:
            after = next((fa[back[k]][2] for k in range(j - 1, -1, -1) if k in back), 0)
            text = _cut(new, p[1], p[2]).rstrip()
            markers.append(("insert", "body", j, 0, base[0] + after, base[0] + after, base[1] + p[1], base[1] + p[1] + utf16_len(text), "", text))
    return markers, messages


def _plain_score(a: str, b: str) -> float:
    words = [set(w.lower() for w in LEXERS["boundary"].findall(t)) for t in (a, b)]
    return part_score(lineage_key(a), lineage_key(b), *words, False)


def _cut(text: str, start: int, end: int) -> str:
    return text.encode("utf-16-le", "surrogatepass")[2 * start : 2 * end].decode("utf-16-le", "surrogatepass")


def _title(text: str) -> str:
    return match_key(re.sub(r"^[\s\[(（【]+|[\s\])）】.:]+$", "", text))


def compare_pair(old: Unit, new: Unit, punctuation: bool = True, moved: bool = False) -> tuple[list[tuple], list[tuple]]:
    """(markers, messages) of two matched units.

    markers: (kind, part, item, hunk, old start, end, new start, end, old text, new
    text); kind is number, label, change, delete or insert, part header or body,
    places are UTF-16 units of the unit, whose body starts one after its header.
    messages: (code, old, new), the status first."""
    base = utf16_len(old.header or "") + 1, utf16_len(new.header or "") + 1
    events = lambda a, b, at, part, item: [("change" if k == "space" else k, part, item, n, at[0] + p, at[0] + q, at[1] + r, at[1] + s, x, y) for n, (k, p, q, r, s, x, y) in enumerate(review_events(a, b, punctuation))]
    if old.kind == "cell" and new.kind == "cell":
        messages = []
        if (old.span or 1, old.vmerge or "none") != (new.span or 1, new.vmerge or "none"):
            messages.append(("cell merge", old.header, new.header))
        if (old.n_par or 1) != (new.n_par or 1):
            messages.append(("cell paragraphs", str(old.n_par), str(new.n_par)))
        return events(old.body or "", new.body or "", base, "body", 0), messages
    markers, messages = [], []
    legal = old.kind == new.kind == "article"
    number = legal and (old.number or "").lower() != (new.number or "").lower()
    retitled = False
    if legal:
        spans = header_spans(old.header or "", old.number or "", old.title or ""), header_spans(new.header or "", new.number or "", new.title or "")
        if number:
            if spans[0][0] >= 0 and spans[1][0] >= 0:
                markers.append(("number", "header", -1, -2, spans[0][0], spans[0][1], spans[1][0], spans[1][1], old.number, new.number))
            messages.append(("renumbered", old.header, new.header))
        if _title(old.title or "") != _title(new.title or ""):
            retitled = True
            at = max(spans[0][2], 0), max(spans[1][2], 0)
            markers += events(old.title or "", new.title or "", at, "header", -1)
            messages.append(("retitled", old.title, new.title))
    elif match_key(old.header or "") != match_key(new.header or ""):
        retitled = True
        markers += events(old.header or "", new.header or "", (0, 0), "header", -1)
    body, told = _body_markers(old.body or "", new.body or "", base, punctuation)
    changed = retitled or any(m[0] != "label" for m in body) or bool(told)
    if number or moved:
        status = "moved and changed" if changed else "moved"
    else:
        status = "structure changed" if told and told[0][0] == "structure" else "changed" if changed else None
    return markers + body, ([("status", status, "")] if status else []) + messages + told


#: One element; a column of structs would have to be a frame.
MARKERS = "array<struct<markers:array<struct<kind:string,part:string,item_order:int,hunk_order:int,old_start:int,old_end:int,new_start:int,new_end:int,old_text:string,new_text:string>>,messages:array<struct<code:string,old:string,new:string>>>>"


def _unit(u) -> Unit:
    get = (lambda n: u.get(n)) if isinstance(u, dict) else (lambda n: getattr(u, n, None))
    clean = lambda x: None if x is None or x != x else x
    return Unit(*[clean(get(n)) for n in FIELDS])


def compare_pair_col(old: Column, new: Column, moved: Column, punctuation: bool = True) -> Column:
    """The struct (markers, messages) of two unit structs."""
    made = vectorized(lambda a, b, m: [compare_pair(_unit(a[0]), _unit(b[0]), punctuation, bool(m))], MARKERS)
    return F.get(made(F.array(old), F.array(new), moved), F.lit(0))


# ---------------------------------------------------------------- whole documents


def compare_units(units: DataFrame, keys: tuple[str, ...] = ("comparison_id",), punctuation: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, markers, messages) of units (keys, doc_ord 0 or 1, FIELDS).

    pairs: (keys, row_id, old_ix, new_ix, score, mode, changed); markers: numbered
    within their row, those of units without a counterpart included; messages:
    (keys, row_id, ord, code, old, new)."""
    k = list(keys)
    units = saved(units.select(*k, "doc_ord", *FIELDS))
    matched = saved(match_units(units, keys))
    side = lambda n, name: units.where(F.col("doc_ord") == n).select(*k, F.col("unit_ix").alias(f"{name}_ix"), F.struct(*FIELDS).alias(name))
    rows = matched.join(side(0, "old"), [*k, "old_ix"], "full").join(side(1, "new"), [*k, "new_ix"], "full")
    # Rows in the order of the old version, additions after the unit before them.
    order = [F.coalesce("old_ix", "__slot"), F.col("old_ix").isNull(), F.col("new_ix")]
    slot = F.coalesce(F.last("old_ix", ignorenulls=True).over(Window.partitionBy(*k).orderBy(F.col("new_ix").asc_nulls_first())), F.lit(-1))
    rows = saved(rows.withColumn("__slot", slot).withColumn("row_id", F.row_number().over(Window.partitionBy(*k).orderBy(*order))).drop("__slot"))
    equal = reduce(and_, [F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")) for c in FIELDS[1:]])
    both = rows.where("old IS NOT NULL AND new IS NOT NULL").where(~equal)
    made = saved(spread(both, *k, "row_id").select(*k, "row_id", "old", "new", compare_pair_col(F.col("old"), F.col("new"), F.col("mode") == "moved", punctuation).alias("m")))
    markers = made.select(*k, "row_id", F.explode("m.markers").alias("e")).select(*k, "row_id", "e.*")
    part = lambda c, p, kind: F.struct(F.lit(kind).alias("kind"), F.lit(p).alias("part"), F.lit(-1 if p == "header" else 0).alias("item_order"), F.lit(0).alias("hunk_order"), *_whole(c, p, kind))
    lone = []
    for name, kind in (("old", "delete"), ("new", "insert")):
        other = "new" if name == "old" else "old"
        alone = rows.where(F.col(other).isNull()).select(*k, "row_id", F.explode(F.array(*[part(F.col(name), p, kind) for p in ("header", "body")])).alias("e")).select(*k, "row_id", "e.*")
        lone.append(alone.where(F.length(F.trim(F.col(f"{name}_text"))) > 0))
    every = markers.unionByName(lone[0]).unionByName(lone[1]).withColumn("pair", F.lit(0))
    numbered = review.numbered(every, (*k, "row_id"), ("pair", "part_order", "item_order", "hunk_order", "old_start", "new_start")).drop("pair")
    messages = made.select(*k, "row_id", F.posexplode("m.messages").alias("ord", "e")).select(*k, "row_id", "ord", "e.*")
    pairs = review.changed_rows(rows.select(*k, "row_id", "old_ix", "new_ix", "score", "mode"), numbered, (*k, "row_id"))
    return pairs, numbered, messages


def _whole(c: Column, part: str, kind: str) -> list[Column]:
    """A whole header or body as the range of a marker."""
    from ..functions.text import utf16_length

    text = F.coalesce(c[part], F.lit(""))
    start = F.lit(0) if part == "header" else utf16_length(F.coalesce(c["header"], F.lit(""))) + 1
    size, zero, empty = utf16_length(text), F.lit(0), F.lit("")
    mine, none = (start.alias("s"), (start + size).alias("e")), (zero.alias("s"), zero.alias("e"))
    old, new = (mine, none) if kind == "delete" else (none, mine)
    texts = (text, empty) if kind == "delete" else (empty, text)
    return [old[0].alias("old_start"), old[1].alias("old_end"), new[0].alias("new_start"), new[1].alias("new_end"), texts[0].alias("old_text"), texts[1].alias("new_text")]


def compare_texts(pairs: DataFrame, keys: tuple[str, ...] = ("comparison_id",), old: str = "old", new: str = "new", punctuation: bool = True):
    """compare_units() of pairs of plain texts."""
    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("doc_ord"), text_units_col(F.coalesce(F.col(c), F.lit(""))).alias("us")) for i, c in enumerate((old, new))])).alias("s")
    return compare_units(pairs.select(*keys, sides).select(*keys, "s.doc_ord", F.explode("s.us").alias("u")).select(*keys, "doc_ord", "u.*"), keys, punctuation)


def compare_documents(pairs: DataFrame, keys: tuple[str, ...] = ("comparison_id",), old: str = "old", new: str = "new", punctuation: bool = True):
    """compare_units() of pairs of word-processor packages (bytes)."""
    from ..sources.docx import blocks_col

    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("doc_ord"), block_units_col(blocks_col(F.col(c))).alias("us")) for i, c in enumerate((old, new))])).alias("s")
    return compare_units(pairs.select(*keys, sides).select(*keys, "s.doc_ord", F.explode("s.us").alias("u")).select(*keys, "doc_ord", "u.*"), keys, punctuation)


__all__ = ["block_units", "compare_documents", "compare_pair", "compare_texts", "compare_units", "text_units"]
