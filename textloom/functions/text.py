"""Text functions: keys for matching, offsets, tokens and labels.

Functions that Catalyst can express return Columns; the others are plain
kernels with an Arrow-batched column form (`<name>_col`). Offsets come in two
kinds, UTF-8 bytes and UTF-16 code units; they are never mixed.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectorized import vectorized

# ---------------------------------------------------------------- newlines, lines


def normalize_newlines(c: Column) -> Column:
    """CRLF and CR as LF."""
    return F.regexp_replace(c, "\r\n?", "\n")


def code_lines(c: Column) -> Column:
    """Lines with their terminators; an empty text has none."""
    return F.regexp_extract_all(c, F.lit("[^\n]*\n|[^\n]+"), F.lit(0))


def display_line(c: Column) -> Column:
    """A line without its terminator."""
    return F.regexp_replace(c, "\r?\n$", "")


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def content_id(c: Column) -> Column:
    return F.sha2(c, 256)


# ---------------------------------------------------------------- keys

_INVISIBLE = {0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x00AD, 0x180E, *range(0xFE00, 0xFE10)}


def _squeeze(text: str) -> str:
    return " ".join(text.split())


def match_key(text: str) -> str:
    """The key under which two texts count as the same unit: composed form, no
    invisible characters, single spaces; letters and digits in compatibility form
    and lower case, punctuation as it is."""
    return _squeeze(unicodedata.normalize("NFC", text).translate(_FOLDED))


class _Each(dict):
    """What a code point becomes, found when it is first met."""

    def __init__(self, of):
        self.of = of

    def __missing__(self, point: int):
        self[point] = self.of(point)
        return self[point]


def _folded(point: int) -> str | None:
    if point in _INVISIBLE:
        return None
    ch = chr(point)
    if point < 0x10000 and unicodedata.category(ch)[0] in "LNM":
        return "".join(x.lower() if len(x.lower()) == 1 else x for x in unicodedata.normalize("NFKC", ch))
    return ch


_FOLDED = _Each(_folded)
_SEEN = _Each(lambda point: None if unicodedata.category(chr(point)) == "Cf" else point)


def visible_key(text: str) -> str:
    """What a reader sees: composed form without format characters, single
    spaces; case and punctuation stay."""
    return _squeeze(unicodedata.normalize("NFC", text).translate(_SEEN))


_MARKER = re.compile(r"^\s*(?:article|section|chapter|clause|제?)\s*[0-9]+(?:[.\-][0-9]+)*\s*(?:조|장|절)?(?:의\s*[0-9]+)?[.):]?\s*", re.I)


def lineage_key(text: str) -> str:
    """The alignment key: without a leading section marker, only Hangul, ASCII
    letters and digits and the per cent sign, lower case."""
    return re.sub(r"[^가-힣A-Za-z0-9%]+", "", _MARKER.sub("", unicodedata.normalize("NFC", text))).lower()


match_key_col = vectorized(match_key, "string")
visible_key_col = vectorized(visible_key, "string")
lineage_key_col = vectorized(lineage_key, "string")


def semantically_equal(a: Column, b: Column) -> Column:
    return visible_key_col(a) == visible_key_col(b)


def compact(c: Column) -> Column:
    """Lower case without white space."""
    return F.lower(F.regexp_replace(c, r"\s+", ""))


def trim_edges(c: Column) -> Column:
    """Without white space and format characters at both ends."""
    return F.regexp_replace(c, r"^[\s\p{Cf}]+|[\s\p{Cf}]+$", "")


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def strip_list_label(c: Column) -> Column:
    """A style key: collapsed white space and no leading list label."""
    return F.regexp_replace(collapse_spaces(c), r"^(?:[0-9]{1,3}[.)]|\([0-9A-Za-z]{1,3}\)|[A-Za-z][.)]|[•▪◦-])\s+", "")


def mask_format_chars(c: Column) -> Column:
    """Format characters of the basic plane as spaces, so that offsets stay."""
    return F.regexp_replace(c, r"[\p{Cf}&&[\u0000-￿]]", " ")


# ---------------------------------------------------------------- tokens


def word_set(c: Column) -> Column:
    """Distinct lower-case words and numbers."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[0-9]+(?:[.,][0-9]+)*|\p{L}[\p{L}\p{M}\p{Nd}]*"), F.lit(0)))


def code_tokens(c: Column) -> Column:
    """Maximal runs of word characters, or of anything else but white space."""
    return F.regexp_extract_all(c, F.lit(r"[\p{L}\p{M}\p{Nd}\p{Pc}]+|[^\p{L}\p{M}\p{Nd}\p{Pc}\s]+"), F.lit(0))


#: Lexers of the review diffs; each is used for one purpose and they differ.
LEXERS = {
    "diff": re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|_+|\s+|[^\w\s]"),
    "boundary": re.compile(r"\w+|[^\w\s]"),
    "similarity": re.compile(r"\w+"),
    "hangul": re.compile(r"[가-힣]+|[A-Za-z]+|\d+|[^\s]"),
    "code": re.compile(r"\w+|[^\w\s]+"),
    "words": re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]\w*"),
}


def tokens(text: str, lexer: str = "diff") -> list[tuple[int, int, str]]:
    """(start, end, token) in UTF-16 units."""
    units = utf16_offsets(text)
    return [(units[m.start()], units[m.end()], m.group()) for m in LEXERS[lexer].finditer(text)]


tokens_col = vectorized(lambda text: [(a, b, t) for a, b, t in tokens(text)], "array<struct<start:int,end:int,text:string>>")


def meaningful_body(c: Column) -> Column:
    return c.rlike(r"[^\s{};]")


def punctuation_only(c: Column) -> Column:
    return ~c.rlike(r"[\p{L}\p{Nd}]") & (F.length(c) > 0)


def definition_head(c: Column) -> Column:
    """The quoted term that a definition starts with ('' if none)."""
    return F.regexp_extract(c, r"^\s*[\"“‘'「『]([^\"”’'」』]{1,80})[\"”’'」』]", 1)


def title_concept_set(title: str) -> set[str]:
    """title_concepts() of one title."""
    words = set(LEXERS["words"].findall(title.lower())) - set(LIGHT_WORDS)
    return {_FAMILY.sub(r"\1", w) for w in words}


_FAMILY = re.compile(r"^([^\W\d_]{4,}?)(?:ations?|ings?|ments?|ions?|ies|es|ed|s)$")


def structure_counts(body: str) -> tuple[int, int, int]:
    """structure_signature() of one body."""
    return tuple(len(re.findall(p, body)) for p in _SIGNATURE)


_SIGNATURE = (r"(?m)^\s*\([0-9]+\)|[①-⑳]", r"(?m)^\s*[0-9]{1,3}[.)]\s", r"(?m)^\s*\(?[a-z가-하][.)]\s")


def has_light_title(title: str) -> bool:
    """low_information_title() of one title."""
    t = " ".join(title.split())
    return t.lower() in LIGHT_TITLES or len(t) < 2


#: Words that say little in a title; our own list.
LIGHT_TITLES = "general others miscellaneous other provisions definitions purpose scope appendix annex supplement introduction overview summary".split()
LIGHT_WORDS = "a an and the of for to in on by with or et al general".split()


def low_information_title(c: Column) -> Column:
    return F.lower(collapse_spaces(c)).isin(LIGHT_TITLES) | (F.length(collapse_spaces(c)) < 2)


def title_concepts(c: Column) -> Column:
    """Distinct title words without light words, cut to a family prefix."""
    words = F.array_except(word_set(c), F.array(*map(F.lit, LIGHT_WORDS)))
    return F.array_distinct(F.transform(words, lambda w: F.regexp_replace(w, r"^(\p{L}{4,}?)(?:ations?|ings?|ments?|ions?|ies|es|ed|s)$", "$1")))


def structure_signature(c: Column) -> Column:
    """How many list labels of each of three styles a body has."""
    return F.struct(*[F.regexp_count(c, F.lit(p)).alias(n) for p, n in zip(_SIGNATURE, ("circled", "numbers", "letters"))])


def hangul_prefix(a: str, b: str) -> str:
    """The common prefix of two words, if it has two Hangul syllables and no white space."""
    n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    p = a[:n]
    return p if len(p) >= 2 and len(re.findall("[가-힣]", p)) >= 2 and not re.search(r"\s", p) else ""


hangul_prefix_col = vectorized(hangul_prefix, "string")


def split_punctuation(text: str) -> list[str]:
    """An edit's leading punctuation and the rest, as pieces."""
    m = re.match(r"[^\w\s]+", text)
    return [p for p in ((m.group(), text[m.end() :]) if m else (text,)) if p]


def split_punctuation_col(c: Column) -> Column:
    """split_punctuation() as an expression."""
    head = r"(?U)^[^\w\s]+"
    return F.filter(F.array(F.regexp_extract(c, head, 0), F.regexp_replace(c, head, "")), lambda x: x != "")


def stable_edge(a: str, b: str, least: int = 40, edge: int = 18) -> bool:
    """Both texts are long and begin or end alike."""
    if min(utf16_len(a), utf16_len(b)) < least:
        return False
    n = min(len(a), len(b))
    pre = next((i for i in range(n) if a[i] != b[i]), n)
    suf = next((i for i in range(n) if a[-1 - i] != b[-1 - i]), n)
    return utf16_len(a[:pre]) >= edge or utf16_len(a[len(a) - suf :]) >= edge


stable_edge_col = vectorized(stable_edge, "boolean")


def stable_sentence(a: str, b: str, least: int = 40) -> bool:
    """The texts share a whole inner sentence of some length."""
    mine = {s for _, _, s in sentences(a) if utf16_len(s) >= least}
    return any(s in mine for _, _, s in sentences(b))


stable_sentence_col = vectorized(stable_sentence, "boolean")


def sentences(text: str, most: int = 128, size: int = 65_536) -> list[tuple[int, int, str]]:
    """(start, end, sentence) in UTF-16 units, terminal marks kept; [] beyond the limits."""
    if utf16_len(text) > size:
        return []
    units, out, start = utf16_offsets(text), [], 0
    for m in re.finditer(r"[.!?。！？…]+[\"'”’)\]]*(?=\s|$)", text):
        out.append((start, m.end()))
        start = m.end()
    if text[start:].strip():
        out.append((start, len(text)))
    trimmed = []
    for a, b in out:
        a += len(text[a:b]) - len(text[a:b].lstrip())
        trimmed.append((units[a], units[b], text[a:b]))
    return trimmed if len(trimmed) < most else []


sentences_col = vectorized(lambda text: sentences(text), "array<struct<start:int,end:int,text:string>>")

# ---------------------------------------------------------------- offsets


def utf16_len(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2


def utf16_offsets(text: str) -> list[int]:
    """The UTF-16 offset of each character, and of the end."""
    if utf16_len(text) == len(text):
        return list(range(len(text) + 1))
    out, at = [0], 0
    for c in text:
        at += 2 if ord(c) > 0xFFFF else 1
        out.append(at)
    return out


def byte_to_utf16(text: str, offset: int) -> int | None:
    """None if the offset is inside a character or outside the text."""
    raw = text.encode()
    if not 0 <= offset <= len(raw):
        return None
    try:
        return utf16_len(raw[:offset].decode())
    except UnicodeDecodeError:
        return None


def utf16_to_byte(text: str, offset: int) -> int | None:
    units = utf16_offsets(text)
    i = bisect_right(units, offset) - 1
    return len(text[:i].encode()) if 0 <= offset <= units[-1] and units[i] == offset else None


byte_to_utf16_col = vectorized(lambda text, offset: byte_to_utf16(text, int(offset)), "int")
utf16_to_byte_col = vectorized(lambda text, offset: utf16_to_byte(text, int(offset)), "int")

# ---------------------------------------------------------------- numbers and labels

_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def to_roman(n: int) -> str:
    out = ""
    for v, s in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        while n >= v:
            out, n = out + s, n - v
    return out


def roman_value(text: str) -> int | None:
    """The value of a canonical Roman number, else None."""
    low = text.lower()
    if not low or any(c not in _ROMAN for c in low):
        return None
    v = [_ROMAN[c] for c in low]
    n = sum(-x if i + 1 < len(v) and x < v[i + 1] else x for i, x in enumerate(v))
    return n if 0 < n < 4000 and to_roman(n) == low else None


def section_number(text: str) -> float | None:
    """12 -> 12.0, 12-3 or 12의3 -> 12.003, Roman numbers by value."""
    m = re.match(r"\s*(\d+)(?:\s*(?:[-.]|의)\s*(\d+))?", text)
    if m:
        return int(m.group(1)) + (int(m.group(2)) / 1000 if m.group(2) else 0)
    r = roman_value(text.strip())
    return float(r) if r is not None else None


def roman_value_col(c: Column) -> Column:
    """roman_value() as an expression: of a canonical number, its pairs and what is left."""
    low = F.lower(c)
    rest = F.regexp_replace(low, "cm|cd|xc|xl|ix|iv", "")
    pairs = sum((F.when(F.instr(low, p) > 0, v).otherwise(0) for p, v in (("cm", 900), ("cd", 400), ("xc", 90), ("xl", 40), ("ix", 9), ("iv", 4))), F.lit(0))
    singles = sum(((F.length(rest) - F.length(F.replace(rest, F.lit(x), F.lit("")))) * v for x, v in _ROMAN.items()), F.lit(0))
    return F.when(low.rlike("^(?=.)m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$"), (pairs + singles).cast("int"))


def section_number_col(c: Column) -> Column:
    """section_number() as an expression."""
    pattern = r"^\s*([0-9]+)(?:\s*(?:[-.]|의)\s*([0-9]+))?"
    major, minor = (F.regexp_extract(c, pattern, i) for i in (1, 2))
    number = major.cast("double") + F.when(minor != "", minor.cast("double") / 1000).otherwise(F.lit(0.0))
    return F.when(major != "", number).otherwise(roman_value_col(F.regexp_replace(c, r"^\s+|\s+$", "")).cast("double"))

#: Syllables of Korean lists in their usual order.
HANGUL_LABELS = "가나다라마바사아자차카타파하"


#: The kinds of list labels, the first pattern that fits; fixed values.
FAMILIES = (
    ("circled", r"^[①-⑳]"),
    ("paren_number", r"^\([0-9]+\)"),
    ("paren_roman", r"^\((?:[ivxlc]{2,}|[ivxIVX]|[IVXLC]{2,})\)"),
    ("paren_alpha", r"^\([A-Za-z]\)"),
    ("number", r"^[0-9]+[.)]"),
    ("alpha", r"^[A-Za-z][.)]"),
    ("hangul", f"^[{HANGUL_LABELS}][.)]"),
)


def label_family(c: Column) -> Column:
    """The kind of a list label."""
    out = F.when(F.coalesce(c, F.lit("")) == "", "body")
    for name, pattern in FAMILIES:
        out = out.when(c.rlike(pattern), name)
    return out.otherwise("other")


def families(labels: list[str]) -> list[str]:
    """label_family() of a body's labels, where a single i, v or x is Roman only if
    a neighbour proves it."""
    out = []
    for i, x in enumerate(labels):
        kind = "body" if not x else next((n for n, p in FAMILIES if re.match(p, x)), "other")
        if kind == "paren_roman" and len(x) == 3 and not any(re.match(r"^\([ivxlc]{2,}\)$", y or "") for y in labels[max(0, i - 1) : i] + labels[i + 1 : i + 2]):
            kind = "paren_alpha"
        out.append(kind)
    return out


def label_ordinal(label: str) -> int | None:
    """The place that a list label names."""
    bare = label.strip().strip("().")
    if not bare:
        return None
    if "①" <= bare[0] <= "⑳":
        return ord(bare[0]) - ord("①") + 1
    if bare.isdecimal():
        return int(bare)
    if bare[0] in HANGUL_LABELS and len(bare) == 1:
        return HANGUL_LABELS.index(bare) + 1
    if len(bare) > 1 and (r := roman_value(bare)) is not None:
        return r
    return ord(bare.lower()) - 96 if len(bare) == 1 and bare.isascii() and bare.isalpha() else roman_value(bare)


label_ordinal_col = vectorized(label_ordinal, "int")


def number_text(n: int, form: str) -> str:
    """A number in a word processor's list format."""
    if form in ("lowerRoman", "upperRoman"):
        return to_roman(n) if form == "lowerRoman" else to_roman(n).upper()
    if form in ("lowerLetter", "upperLetter") and n > 0:
        s = chr(97 + (n - 1) % 26) * ((n - 1) // 26 + 1)
        return s if form == "lowerLetter" else s.upper()
    return str(n)


# ---------------------------------------------------------------- paths, XML, units

#: Folders that hold builds, not sources.
EXCLUDED_FOLDERS = [".git", ".vs", ".idea", "bin", "obj", "node_modules", "target"]
CODE_EXTENSIONS = "c cc cpp cs css fs go h hpp html java js json jsx kt lua m php pl py rb rs scala sh sql swift ts tsx vb xml yaml".split()


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def supported_file(path: Column) -> Column:
    return extension(path).isin(CODE_EXTENSIONS + ["docx", "txt"])


def safe_relative_path(path: Column) -> Column:
    """Neither rooted, nor with . or .. or empty parts, nor in an excluded folder."""
    parts = F.split(path, r"[/\\]")
    return (F.length(path) > 0) & ~path.rlike(r"^([/\\]|[A-Za-z]:)|\x00") & ~F.exists(parts, lambda p: (p == "") | p.isin(".", "..")) & ~F.arrays_overlap(F.transform(parts, F.lower), F.array(*map(F.lit, EXCLUDED_FOLDERS)))


def xml_text(c: Column) -> Column:
    """Without characters that XML 1.0 forbids, and escaped."""
    ok = F.regexp_replace(c, r"[^\x09\x0A\x0D\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        ok = F.replace(ok, F.lit(a), F.lit(b))
    return ok


def twips_to_points(c: Column) -> Column:
    return c / 20


def half_points_to_points(c: Column) -> Column:
    return c / 2


def line_spacing(value: Column, rule: Column) -> Column:
    """'1.5x' for automatic spacing (240ths of a line), else points."""
    return F.when(F.coalesce(rule, F.lit("auto")) == "auto", F.concat(F.format_number(value / 240, 2), F.lit("x"))).otherwise(F.concat(F.format_number(value / 20, 1), F.lit(" pt")))
