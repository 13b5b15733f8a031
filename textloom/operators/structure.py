"""Structure of documents: articles, sections, blocks, list items and levels.

A document is read as a whole by one call, since headings depend on what came
before; documents are spread by their rows. Grammars and word lists are our own.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import HANGUL_LABELS, label_ordinal, section_number, utf16_length, utf16_offsets
from ..functions.vectorized import arrowed, vectorized

_ARTICLE = re.compile(r"^\s*(?:(?:article|section|clause|§)\s*(?P<n>\d+(?:[.\-]\d+)*|[IVXLC]+)|제\s*(?P<k>\d+)\s*조(?:의\s*(?P<kk>\d+))?)\s*(?P<rest>.*)$", re.I)
_GROUP = re.compile(r"^\s*(?:(?:part|chapter|title|book)\s+(?:\d+|[IVXLC]+)\b|제\s*\d+\s*(?:편|장|절|관))\s*(?P<rest>.*)$", re.I)
_MODAL = re.compile(r"\b(?:shall|must|may|will|should|is|are|was|were)\b|(?:다|요)\.?$", re.I)
_NUMBERED = re.compile(r"^\s*(?P<n>\d{1,2}(?:\.\d{1,2}){0,3})[.)]?\s+(?P<title>\S.{0,79})$")
_INLINE = re.compile(r"(?<=[.;:!?。])[ \t]+(?=(?:(?:Article|Section|Clause)\s+\d+(?:[.\-]\d+)*\s*[.(:\[]|제\s*\d+\s*조(?:의\s*\d+)?\s*[(\[（【]))")
LEGAL_HEADINGS = 2


def is_title(text: str) -> bool:
    """Short, few words, no sentence."""
    t = text.strip()
    return 0 < len(t) <= 80 and len(t.split()) <= 12 and not _MODAL.search(t) and not re.search(r"[.;,]$", t)


def looks_legal(c: Column) -> Column:
    """The text has at least two lines that open an article."""
    return F.regexp_count(c, F.lit(r"(?im)^\s*(?:(?:article|section|clause|§)\s*(?:\d+|[IVXLC]+)\b|제\s*\d+\s*조)")) >= LEGAL_HEADINGS


def recover_breaks(text: str) -> str:
    """A line break before titled article headings that a flattened text has
    inside a line, after a terminal mark."""
    return _INLINE.sub("\n", text)


def _article(line: str):
    m = _ARTICLE.match(line)
    if not m:
        return None
    number = m["n"] or m["k"] + (f"-{m['kk']}" if m["kk"] else "")
    rest = m["rest"].strip()
    t = re.match(r"^[\[(（【](?P<t>[^\])）】]{1,80})[\])）】]\s*(?P<b>.*)$", rest) or re.match(r"^[.:–-]?\s*(?P<t>[^.:]{0,80}?)(?:[.:]\s+(?P<b>.*)|$)", rest)
    title, body = (t["t"].strip(), (t["b"] or "").strip()) if t else ("", rest)
    if title and not is_title(title):
        title, body = "", rest
    return number, title, body


def false_headings(numbers: list[float | None]) -> set[int]:
    """Places of headings whose number breaks a run that goes on without them:
    by 3 or more if the number comes again, else by 6 or more."""
    out: set[int] = set()
    while True:
        live = [i for i in range(len(numbers)) if i not in out and numbers[i] is not None]
        bad = None
        for a, i, b in zip(live, live[1:], live[2:]):
            x, y, z = numbers[a], numbers[i], numbers[b]
            if 0 < z - x <= 1:
                jump = min(abs(y - x), abs(y - z))
                if jump >= 6 or jump >= 3 and any(numbers[j] == y for j in live if j > i):
                    bad = i
                    break
        if bad is None:
            return out
        out.add(bad)


def legal_units(text: str) -> list[tuple]:
    """(kind, number, title, header, body, section) of a text with articles."""
    lines = recover_breaks(text).replace("\r\n", "\n").replace("\r", "\n").split("\n")
    heads = [(i, _article(x)) for i, x in enumerate(lines)]
    heads = [(i, h) for i, h in heads if h]
    wrong = false_headings([section_number(h[0]) for _, h in heads])
    at = {i: h for k, (i, h) in enumerate(heads) if k not in wrong}
    out, current, section = [], None, []

    def close():
        if current and (current[3] or any(x.strip() for x in current[4])):
            out.append((current[0], current[1], current[2], current[3], "\n".join(current[4]).strip(), current[5]))

    for i, line in enumerate(lines):
        group = _GROUP.match(line)
        if i in at:
            close()
            number, title, body = at[i]
            if not title and not body and i + 1 < len(lines) and i + 1 not in at and is_title(lines[i + 1]):
                title = lines[i + 1].strip()
            current = ["article", number, title, line.strip() if not body else line[: line.rfind(body)].strip(), [body] if body else [], " > ".join(section)]
        elif group and (not group["rest"] or is_title(group["rest"])):
            close()
            level = next((k for k, w in enumerate(("book", "part", "편", "title", "chapter", "장", "절", "관")) if w in line.lower()), 0)
            section = [s for s in section if next((k for k, w in enumerate(("book", "part", "편", "title", "chapter", "장", "절", "관")) if w in s.lower()), 0) < level] + [line.strip()]
            current = ["section", "", group["rest"].strip(), line.strip(), [], " > ".join(section)]
        else:
            if current is None:
                current = ["preamble", "", "", "", [], ""]
            current[4].append(line)
    close()
    return out


def general_heading(line: str) -> tuple[str, str] | None:
    """(number, title) of a heading line of a text without articles."""
    m = _NUMBERED.match(line)
    if m and is_title(m["title"]):
        return m["n"], m["title"].strip()
    t = line.strip()
    words = [w for w in re.findall(r"[^\W\d_]+", t) if len(w) > 3]
    if is_title(t) and words and len(t) <= 60 and (t.isupper() or len(words) > 1 and all(w[0].isupper() for w in words)):
        return "", t
    return None


def general_units(text: str) -> list[tuple]:
    """A heading opens a unit; without one each paragraph is a unit."""
    out, current, section = [], None, ""
    for para in re.split(r"\n\s*\n|\n", text.replace("\r\n", "\n").replace("\r", "\n")):
        if not para.strip():
            continue
        head = general_heading(para)
        if head:
            if current:
                out.append(tuple(current))
            section = head[1]
            current = ["section", head[0], head[1], para.strip(), "", section]
        elif current:
            current[4] = f"{current[4]}\n{para.strip()}" if current[4] else para.strip()
        else:
            out.append(("block", "", "", "", para.strip(), ""))
    if current:
        out.append(tuple(current))
    return out


def units(text: str, mode: str = "auto") -> list[tuple]:
    """Units of a text; mode is legal, general or auto (legal from two article lines on)."""
    if mode == "auto":
        mode = "legal" if sum(bool(_article(x)) for x in recover_breaks(text).splitlines()) >= LEGAL_HEADINGS else "general"
    return legal_units(text) if mode == "legal" else general_units(text)


UNIT = "array<struct<kind:string,number:string,title:string,header:string,body:string,section:string>>"
units_col = arrowed(lambda text, mode: units(text, mode), UNIT)


def parse_units(docs: DataFrame, text: str = "text", mode: str = "auto", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, unit_ix, kind, number, title, header, body, section)."""
    found = units_col(F.coalesce(F.col(text), F.lit("")), F.lit(mode))
    return docs.select(*keys, F.posexplode(found).alias("unit_ix", "u")).select(*keys, "unit_ix", "u.*")


def header_spans(header: str, number: str, title: str) -> tuple[int, int, int, int]:
    """Offsets of number and title in a header, in UTF-16 units (-1: not there)."""
    u = utf16_offsets(header)
    i = header.find(number) if number else -1
    j = header.find(title, max(i, 0)) if title else -1
    return (u[i] if i >= 0 else -1, u[i + len(number)] if i >= 0 else -1, u[j] if j >= 0 else -1, u[j + len(title)] if j >= 0 else -1)


def header_spans_col(header: Column, number: Column, title: Column) -> Column:
    """header_spans() as an expression: a struct of four offsets."""
    none = F.lit(-1)
    i = F.when(number != "", F.call_function("locate", number, header) - 1).otherwise(none)
    j = F.when(title != "", F.call_function("locate", title, header, F.greatest(i, F.lit(0)) + 1) - 1).otherwise(none)
    at = lambda n: utf16_length(F.substring(header, F.lit(1), n))
    ends = [x for p, t in ((i, number), (j, title)) for x in (F.when(p >= 0, at(p)).otherwise(none), F.when(p >= 0, at(p + F.length(t))).otherwise(none))]
    return F.struct(*[x.alias(n) for x, n in zip(ends, ("number_start", "number_end", "title_start", "title_end"))])


# ---------------------------------------------------------------- list items

_LABEL = rf"(?:[①-⑳]|\((?:\d{{1,3}}|[A-Za-z]|[ivxlc]{{2,6}})\)|\d{{1,3}}[.)](?=\s)|[A-Za-z][.)](?=\s)|[{HANGUL_LABELS}][.)](?=\s)|[•▪◦](?=\s))"
_AT_LINE = re.compile(rf"(?m)^[ \t]*({_LABEL})[ \t]*")
_AFTER_GAP = re.compile(rf"(?:[ \t]{{2,}})({_LABEL})[ \t]*")
_AFTER_SPACE = re.compile(rf"(?<=\S)[ \t]({_LABEL})[ \t]*")


def parts(body: str) -> list[tuple]:
    """(label, start, end, core start, core end, core) of a body's list items in
    UTF-16 units. Text before the first label is a part without one. A label
    inside a line counts after two spaces, or after one in a run of three labels
    that go on from each other, or of two whose first opens the line."""
    marks = {m.start(1): (m.group(1), m.end()) for p in (_AT_LINE, _AFTER_GAP) for m in p.finditer(body)}
    opens = {m.start(1) for m in _AT_LINE.finditer(body)}
    soft = {m.start(1): (m.group(1), m.end()) for m in _AFTER_SPACE.finditer(body) if m.start(1) not in marks}
    run: list[int] = []
    for at, (label, _) in sorted((marks | soft).items()):
        n = label_ordinal(label)
        goes_on = run and n is not None and label_ordinal((marks | soft)[run[-1]][0]) == n - 1 and "\n" not in body[run[-1] : at]
        run = [*run, at] if goes_on else [at]
        if len(run) >= (2 if run[0] in opens else 3):
            marks.update({x: soft[x] for x in run if x in soft})
    starts = sorted(marks)
    if not starts:
        return [_part("", 0, len(body), 0, body, utf16_offsets(body))] if body.strip() else []
    u = utf16_offsets(body)
    out = [_part("", 0, starts[0], 0, body, u)] if body[: starts[0]].strip() else []
    for s, e in zip(starts, [*starts[1:], len(body)]):
        out.append(_part(marks[s][0], s, e, marks[s][1], body, u))
    return out


def _part(label, start, end, core, body, u):
    text = body[core:end]
    a, b = core + len(text) - len(text.lstrip()), core + len(text.rstrip())
    b = max(a, b)
    return (label, u[start], u[end], u[a], u[b], body[a:b])


PART = "array<struct<label:string,start:int,end:int,core_start:int,core_end:int,core:string>>"
parts_col = vectorized(parts, PART)


def parse_parts(units: DataFrame, body: str = "body", keys: tuple[str, ...] = ("doc_id", "unit_ix")) -> DataFrame:
    found = parts_col(F.coalesce(F.col(body), F.lit("")))
    return units.select(*keys, F.posexplode(found).alias("part_ix", "p")).select(*keys, "part_ix", "p.*")


def roman_in_context(parts: DataFrame, keys: tuple[str, ...] = ("doc_id", "unit_ix")) -> DataFrame:
    """parts with their family, where a single i, v or x is Roman only if a
    neighbour proves it."""
    from ..functions.text import label_family

    w = Window.partitionBy(*keys).orderBy("part_ix")
    plain = label_family(F.col("label"))
    single = F.col("label").rlike(r"^\([ivxIVX]\)$")
    near = lambda step: F.coalesce(step("label").over(w), F.lit(""))
    proof = r"^\((?:[ivxlc]{2,})\)$"
    is_roman = near(F.lag).rlike(proof) | near(F.lead).rlike(proof)
    return parts.withColumn("family", F.when(single & ~is_roman, "paren_alpha").otherwise(plain))


def hierarchy(labels: list[str], families: list[str]) -> list[tuple[int, int]]:
    """(level, parent index) of each part: a family opens a level below the
    current one when it is first met, and comes back to its own later on."""
    out, stack = [], []
    for i, (label, family) in enumerate(zip(labels, families)):
        if family == "body" or not label:
            out.append((0, -1))
            continue
        known = next((k for k, (f, _) in enumerate(stack) if f == family), None)
        if known is not None and label_ordinal(label) == 1 and stack[-1][0] != family and len(stack) < 4:
            known = known if known < len(stack) - 1 else None
        if known is None:
            if len(stack) == 4:
                stack.pop()
            stack.append((family, i))
        else:
            del stack[known + 1 :]
            stack[known] = (family, i)
        out.append((len(stack), stack[-2][1] if len(stack) > 1 else -1))
    return out


hierarchy_col = vectorized(lambda labels, families: hierarchy(list(labels), list(families)), "array<struct<level:int,parent:int>>")


def part_levels(parts: DataFrame, keys: tuple[str, ...] = ("doc_id", "unit_ix")) -> DataFrame:
    """parts with family, ordinal, level and parent; a unit's parts are one row
    while their levels are found, and a unit's body bounds their number."""
    from ..functions.text import label_ordinal_col

    named = roman_in_context(parts, keys).withColumn("ordinal", label_ordinal_col(F.col("label")))
    whole = named.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("part_ix", *[c for c in named.columns if c not in (*keys, "part_ix")]))).alias("all"))
    whole = whole.withColumn("tree", hierarchy_col(F.col("all.label"), F.col("all.family")))
    return whole.select(*keys, F.explode(F.arrays_zip("all", "tree")).alias("z")).select(*keys, "z.all.*", "z.tree.*")


