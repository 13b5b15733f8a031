"""Fill-in-middle documents over a sparse checkpoint index.

A text is counted once, in units: code points, or the matches of a pattern from
left to right over code points (what lies between two matches belongs to the
earlier one, what lies before the first to it). While counting, the byte and
code-point offsets of every `every`-th unit are recorded. A cut after u units is
then found by a binary search of the checkpoints and a rescan of at most `every`
units, on the text's UTF-8 bytes; the index of a text holds n / every entries,
whatever its length, and no list of all units is made.

A document is cut into prefix, middle and suffix and written in one of three
forms: plain (the text), psm (prefix, suffix, middle) or spm (suffix, prefix,
middle), each part behind its sentinel. A text that holds a sentinel stays plain,
so restored() gets every text back from its output and form alone.

Each row is decided by itself: no shuffle, and memory is a batch of texts.

Defined cases: a null or empty text is empty and plain; a null id draws like the
empty id; repeated rows are cut alike; a pattern without a match gives no unit
and cuts at both ends; other columns don't matter, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, trimmed

#: Prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
EVERY = 1024
#: Bytes that are counted at a time.
BLOCK = 1 << 16


class Points:
    """Checkpoints of a text whose units are its code points."""

    def __init__(self, data: bytes, every: int = EVERY):
        self.data, self.every, self.n = np.frombuffer(data, np.uint8), every, 0
        at = []
        for start in range(0, len(self.data), BLOCK):
            leads = self._leads(start, start + BLOCK)
            at.append(leads[-self.n % every :: every] + start)
            self.n += len(leads)
        #: Of each checkpoint its unit, which is its code point as well, and its byte.
        self.bytes = np.concatenate(at) if at else np.zeros(0, np.int64)
        self.units = self.points = np.arange(len(self.bytes), dtype=np.int64) * every

    def _leads(self, start: int, end: int) -> np.ndarray:
        return np.flatnonzero((self.data[start:end] & 0xC0) != 0x80)

    def cut(self, u: int) -> tuple[int, int]:
        """(byte, code point) where u units have ended."""
        if u >= self.n:
            return len(self.data), self.n
        c = int(np.searchsorted(self.units, u, "right")) - 1
        start, left = int(self.bytes[c]), u - int(self.units[c])
        return start + int(self._leads(start, start + 4 * (left + 1))[left]), u


class Matches:
    """Checkpoints of a text whose units are the matches of a pattern."""

    def __init__(self, data: bytes, pattern: re.Pattern, every: int = EVERY):
        self.text, self.pattern, self.size, self.n = data.decode("utf-8", "surrogateescape"), pattern, len(data), 0
        units, at_bytes, points = [], [], []
        size = point = 0
        for m in pattern.finditer(self.text):
            if self.n % every == 0:
                start = m.start() if self.n else 0
                size, point = size + self._size(point, start), start
                units.append(self.n)
                at_bytes.append(size)
                points.append(point)
            self.n += 1
        self.units, self.bytes, self.points = (np.array(x, np.int64) for x in (units, at_bytes, points))

    def _size(self, start: int, end: int) -> int:
        return len(self.text[start:end].encode("utf-8", "surrogateescape"))

    def cut(self, u: int) -> tuple[int, int]:
        """(byte, code point) where u units have ended and the next one begins."""
        if u >= self.n:
            return self.size, len(self.text)
        if not u:
            return 0, 0
        c = int(np.searchsorted(self.units, u, "right")) - 1
        start, left = int(self.points[c]), u - int(self.units[c])
        for i, m in enumerate(self.pattern.finditer(self.text, start)):
            if i == left:
                return int(self.bytes[c]) + self._size(start, m.start()), m.start()
        raise ValueError("a pattern whose matches depend on where a scan starts")


def check_sentinels(sentinels: tuple[str, str, str]) -> None:
    """Each must be found again behind any text that holds none of them: their
    first characters may stand nowhere else in them."""
    if len(set(sentinels)) != 3 or not all(sentinels) or any(t[0] in s[1:] for s in sentinels for t in sentinels):
        raise ValueError("sentinels that a text's end could complete")
    if any(s != t and t.startswith(s) for s in sentinels for t in sentinels):
        raise ValueError("a sentinel that begins another")


def draws(key: Column, seed: int = 1) -> list[Column]:
    """Four numbers below 2 ** 32 of an id: two cuts, the form and its order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str | None = None, every: int = EVERY, plain: int = 10, spm: int = 20, seed: int = 1, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, prefix_bytes, middle_bytes, output)
    of each row: n units, and of texts that are cut the code points and bytes of
    prefix and middle (null if plain).

    unit: a pattern whose matches are the units (None: code points). `plain` of
    100 texts stay as they are, `spm` of 100 others put the suffix first."""
    check_sentinels(sentinels)
    marks = [s.encode() for s in sentinels]
    p, s, m = marks
    pattern = None if unit is None else re.compile(unit)
    if pattern and pattern.match(""):
        raise ValueError("a unit has a character at least")
    frame = bounded_batches(docs).select(docs[key].cast("long").alias(key), F.coalesce(docs[text].cast("string"), F.lit("")).cast("binary").alias("text"), *[d.alias(f"h{i}") for i, d in enumerate(draws(docs[key].cast("long"), seed), 1)])

    def one(data: bytes, h1: int, h2: int, h3: int, h4: int) -> tuple:
        index = Points(data, every) if pattern is None else Matches(data, pattern, every)
        if not data or h3 % 100 >= 100 - plain or any(x in data for x in marks):
            return index.n, "plain", None, None, None, None, data
        first, last = sorted((h1 % (index.n + 1), h2 % (index.n + 1)))
        (b1, c1), (b2, c2) = index.cut(first), index.cut(last)
        parts = data[:b1], data[b1:b2], data[b2:]
        if h4 % 100 < spm:
            form, out = "spm", b"".join((s, parts[2], p, parts[0], m, parts[1]))
        else:
            form, out = "psm", b"".join((p, parts[0], s, parts[2], m, parts[1]))
        return index.n, form, c1, c2 - c1, b1, b2 - b1, out

    kinds = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "prefix_bytes": pa.int64(), "middle_bytes": pa.int64(), "output": pa.binary()}

    def run(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            rows = [one(t.as_py(), *h) for t, *h in zip(b.column(1), *(b.column(i).to_pylist() for i in range(2, 6)))]
            cols = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols[:-1], cols[-1].view(pa.string())], names=[key, *kinds])
        trimmed()

    return frame.mapInArrow(run, f"`{key}` long, n long, form string, prefix_chars long, middle_chars long, prefix_bytes long, middle_bytes long, output string")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text of an output, from its sentinels alone."""
    p, s, m = sentinels
    before = lambda c, mark: F.substring_index(c, mark, 1)
    behind = lambda c, mark: F.substring_index(c, mark, -1)
    tail = lambda c, mark: c.substr(F.lit(len(mark) + 1), F.length(c))
    psm = F.concat(tail(before(output, s), p), behind(output, m), before(behind(output, s), m))
    spm = F.concat(before(behind(output, p), m), behind(output, m), tail(before(output, p), s))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def query(spark, sf_dir):
    from .common import table

    made = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c, 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), k AS (
  SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS b,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS h4 FROM d
), f AS (
  SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form,
         least(a, b) AS x, greatest(a, b) AS y FROM k
), p AS (
  SELECT *, substring(t, 1, x) AS prefix, substring(t, x + 1, y - x) AS middle, substring(t, y + 1) AS suffix FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN x END AS prefix_chars, CASE WHEN form <> 'plain' THEN y - x END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
