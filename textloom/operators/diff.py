"""Sequence comparison: line hunks, token blocks and typed review events.

The kernels work on one pair of texts; the DataFrame forms run them in Arrow
batches, one row a pair, so a corpus of pairs is spread by its rows and no
pair meets another. A pair beyond the cell limit gives one replacement.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import matching_blocks
from ..functions.text import LEXERS, hangul_prefix, match_key, sentences, split_punctuation, stable_edge, tokens, utf16_len, utf16_offsets, visible_key
from ..functions.vectorized import vectorized

CELLS = 4_000_000
Block = tuple[int, int, int]


def lcs_pairs(a: Sequence, b: Sequence, cells: float = CELLS) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence: from the start on, equal
    elements are kept, and where either side could go the element of a is dropped
    first. Beyond `cells`, matching blocks.

    The lengths of common subsequences of all suffixes are kept as whole numbers,
    a bit a place of a (Hyyrö, 2004), so a step costs a few machine words.
    """
    n, m = len(a), len(b)
    if (n + 1) * (m + 1) > cells:
        return [(i + k, j + k) for i, j, size in matching_blocks(a, b) for k in range(size)]
    where: dict = {}
    for i, x in enumerate(reversed(a)):
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << n) - 1
    rows, v = [full], full
    for y in reversed(b):
        u = v & where.get(y, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)

    def left(i, j):
        """Length of the longest common subsequence of a[i:] and b[j:]."""
        return (n - i) - (rows[m - j] & ((1 << (n - i)) - 1)).bit_count()

    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif left(i + 1, j) >= left(i, j + 1):
            i += 1
        else:
            j += 1
    return out


def opcodes(blocks: list[Block]) -> list[tuple[str, int, int, int, int]]:
    """Gaps between blocks as (insert | delete | replace, a0, a1, b0, b1)."""
    out, i, j = [], 0, 0
    for x, y, n in blocks:
        if i < x or j < y:
            out.append(("replace" if i < x and j < y else "delete" if i < x else "insert", i, x, j, y))
        i, j = x + n, y + n
    return out


def _gaps(pairs: list[tuple[int, int]], n: int, m: int) -> list[tuple[str, int, int, int, int]]:
    return opcodes([(i, j, 1) for i, j in pairs] + [(n, m, 0)])


def line_hunks(before: str, after: str, cells: int = CELLS) -> list[tuple[str, int, int, int, int]]:
    """(kind, before start, end, after start, end), half-open line ranges. Where
    the changed middles have more than `cells` pairs of lines, they are one
    replacement (limited_hunks() tells)."""
    a, b = (re.findall(r"[^\n]*\n|[^\n]+", x) for x in (before, after))
    n = min(len(a), len(b))
    pre = next((i for i in range(n) if a[i] != b[i]), n)
    n -= pre
    suf = next((i for i in range(n) if a[-1 - i] != b[-1 - i]), n)
    x, y = a[pre : len(a) - suf], b[pre : len(b) - suf]
    if not x and not y:
        return []
    if not x or not y or len(x) * len(y) > cells:
        kind = "insert" if not x else "delete" if not y else "replace"
        return [(kind, pre, pre + len(x), pre, pre + len(y))]
    return [(k, p + pre, q + pre, r + pre, s + pre) for k, p, q, r, s in _gaps(lcs_pairs(x, y, float("inf")), len(x), len(y))]


def limited_hunks(before: str, after: str, cells: int = CELLS) -> list[tuple]:
    """line_hunks() with a flag: the limit made this hunk one replacement."""
    return [(*h, h[0] == "replace" and (h[2] - h[1]) * (h[4] - h[3]) > cells) for h in line_hunks(before, after, cells)]


HUNK = "array<struct<kind:string,before_start:int,before_end:int,after_start:int,after_end:int,limited:boolean>>"
line_hunks_col = vectorized(limited_hunks, HUNK)


def diff_lines(pairs: DataFrame, before: str = "before", after: str = "after", keep: tuple[str, ...] = ("pair_id",)) -> DataFrame:
    """One row a hunk; equal pairs, which most are in a version history, never
    leave the JVM."""
    changed = pairs.where(~F.col(before).eqNullSafe(F.col(after)))
    a, b = (F.coalesce(F.col(c), F.lit("")) for c in (before, after))
    hunks = line_hunks_col(a, b)
    return changed.select(*keep, F.posexplode(hunks).alias("ord", "h")).select(*keep, (F.col("ord") + 1).alias("ord"), "h.*")


# ---------------------------------------------------------------- review events


def whitespace_events(a: str, b: str) -> list[tuple[int, int, int, int]] | None:
    """Spans of words whose white space differs; None if more than that does."""
    if "".join(a.split()) != "".join(b.split()):
        return None
    ua, ub = utf16_offsets(a), utf16_offsets(b)

    def gaps(x):
        """White space before each black character, with its place, and after the last."""
        out, start = [], 0
        for i, c in enumerate(x):
            if not c.isspace():
                out.append((start, i))
                start = i + 1
        return [*out, (start, len(x))]

    def context(x, p, q):
        while p > 0 and not x[p - 1].isspace():
            p -= 1
        while q < len(x) and not x[q].isspace():
            q += 1
        return p, q

    out: list[list[int]] = []
    for (p, q), (r, s) in zip(gaps(a), gaps(b)):
        if a[p:q] != b[r:s]:
            (p, q), (r, s) = context(a, p, q), context(b, r, s)
            if out and (p <= out[-1][1] or r <= out[-1][3]):
                out[-1][1], out[-1][3] = max(q, out[-1][1]), max(s, out[-1][3])
            else:
                out.append([p, q, r, s])
    return [(ua[p], ua[q], ub[r], ub[s]) for p, q, r, s in out]


def sentence_events(a: str, b: str) -> list[tuple[int, int, int, int]] | None:
    """Gaps between sentences that both texts keep in order; None if the texts
    are short or repeat a sentence, or share no long one."""
    x, y = sentences(a), sentences(b)
    if min(utf16_len(a), utf16_len(b)) < 96 or min(len(x), len(y)) < 2:
        return None
    kx, ky = [match_key(s) for _, _, s in x], [match_key(s) for _, _, s in y]
    if len(set(kx)) < len(kx) or len(set(ky)) < len(ky):
        return None
    pairs = lcs_pairs(kx, ky)
    if not any(len(kx[i]) >= 40 for i, _ in pairs):
        return None
    gaps = _gaps(pairs, len(x), len(y))
    if any(k == "replace" for k, *_ in gaps):
        return None
    edge = lambda s, i, text: s[i][0] if i < len(s) else utf16_len(text)
    return [(edge(x, p, a), x[q - 1][1] if q > p else edge(x, p, a), edge(y, r, b), y[s - 1][1] if s > r else edge(y, r, b)) for _, p, q, r, s in gaps]


def _cut(text: str, start: int, end: int) -> str:
    return text.encode("utf-16-le", "surrogatepass")[2 * start : 2 * end].decode("utf-16-le", "surrogatepass")


def project(a: str, b: str, position: int) -> int:
    """The place in b that an offset in a stands for: that of the nearest word
    before it that both have, without one the place by matching characters; after
    the end of a sentence its closing marks are passed."""
    x, y = tokens(a, "boundary"), tokens(b, "boundary")
    best = None
    for i, j, n in matching_blocks([t for _, _, t in x], [t for _, _, t in y]):
        for k in range(n):
            if x[i + k][1] <= position:
                best = y[j + k][1]
            elif x[i + k][0] <= position:
                return y[j + k][0] + position - x[i + k][0]
    if best is None:
        ua, ub, best = utf16_offsets(a), utf16_offsets(b), 0
        for i, j, n in matching_blocks(a, b):
            if n and ua[i] <= position:
                best = ub[j] + position - ua[i] if position <= ua[i + n] else ub[j + n]
    while _cut(b, best - 1, best) in _ENDS and best and _cut(b, best, best + 1) in _CLOSING:
        best += 1
    return best


_ENDS, _CLOSING = set(".!?。！？…\"'”’)]"), set(".!?。！？…\"'”’)]")


def review_events(a: str, b: str, punctuation: bool = True) -> list[tuple[str, int, int, int, int, str, str]]:
    """(kind, a start, a end, b start, b end, old text, new text) of a pair of
    texts, in UTF-16 units; kind is change, insert, delete or space."""
    if a == b or visible_key(a) == visible_key(b) and "".join(a.split()) != "".join(b.split()):
        return []
    spaces = whitespace_events(a, b)
    if spaces is not None:
        return [("space", p, q, r, s, _cut(a, p, q), _cut(b, r, s)) for p, q, r, s in spaces]
    kept = sentence_events(a, b)
    if kept is not None:
        spans = kept
    else:
        x, y = tokens(a), tokens(b)
        key = lambda t: " " if t.isspace() else t
        gaps = opcodes(matching_blocks([key(t) for _, _, t in x], [key(t) for _, _, t in y]))
        at = lambda s, i, text: s[i][0] if i < len(s) else utf16_len(text)
        spans = [(at(x, p, a), x[q - 1][1] if q > p else at(x, p, a), at(y, r, b), y[s - 1][1] if s > r else at(y, r, b)) for _, p, q, r, s in gaps]
    out = []
    for p, q, r, s in spans:
        old, new = _cut(a, p, q), _cut(b, r, s)
        if old and new and (shared := hangul_prefix(old, new)) and shared not in (old, new):
            n = utf16_len(shared)
            p, r, old, new = p + n, r + n, _cut(a, p + n, q), _cut(b, r + n, s)
        if not (old.strip() or new.strip()) or not punctuation and not re.search(r"[^\W_]", old + new):
            continue
        if old and new:
            out.append(("change", p, q, r, s, old, new))
        elif old:
            for piece in split_punctuation(old):
                out.append(("delete", p, p + utf16_len(piece), r, r, piece, ""))
                p += utf16_len(piece)
        else:
            for piece in split_punctuation(new):
                out.append(("insert", p, p, r, r + utf16_len(piece), "", piece))
                r += utf16_len(piece)
    return out


EVENT = "array<struct<kind:string,old_start:int,old_end:int,new_start:int,new_end:int,old_text:string,new_text:string>>"
review_events_col = vectorized(lambda a, b: review_events(a, b), EVENT)
whitespace_events_col = vectorized(whitespace_events, "array<struct<old_start:int,old_end:int,new_start:int,new_end:int>>")
project_col = vectorized(lambda a, b, position: project(a, b, int(position)), "int")


def whole_rewrite(a: str, b: str, score: float, parts: int) -> bool:
    """A short plain body that was written anew counts as one change."""
    return parts <= 1 and score < 0.72 and not stable_edge(a, b) and max(utf16_len(a), utf16_len(b)) < 96


#: A deletion and an insertion are near within a tenth of their texts, from 6 to 28 units, and
#: twice that in one list item, which also counts for 4 units (fixed values).
NEAREST, FARTHEST, OF_TEXT, SAME_ITEM = 6, 28, 0.1, 4


def assigned(candidates: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(deletion, insertion) pairs of (score, deletion, insertion) candidates: from the least
    score on, each deletion once and each insertion once. A deletion whose best insertion is
    taken stays alone."""
    tried, taken, out = set(), set(), []
    for _, d, a in sorted(candidates):
        if d not in tried:
            tried.add(d)
            if a not in taken:
                taken.add(a)
                out.append((d, a))
    return sorted(out)


_assigned_col = vectorized(lambda c: assigned([(int(x["score"]), int(x["deletion"]), int(x["addition"])) for x in c]), "array<struct<deletion:int,addition:int>>")


def replacement_pairs(markers: DataFrame, keys: tuple[str, ...] = ("pair_id",)) -> DataFrame:
    """(keys, part, deletion, addition) of deletions and insertions that are one replacement.

    markers: (keys, part, ix, kind, visible, old_start, old_end, new_start, new_end,
    text_length, item). A pair lies in one part, shows different texts, and the
    insertion's place is near the deletion's old range as the deletion's place is to
    the insertion's new range. Candidates meet by ranges of old places (BIN units), since
    none is farther than twice FARTHEST; the sum of both distances decides.

    Markers of no text, of other kinds or with both ranges take no part; null keys and parts are
    values like others; repeated markers are told once."""
    k = [*keys, "part"]
    reach, width = 2 * FARTHEST, 64
    some = F.col("visible").isNotNull()
    m = markers.where(some).distinct()
    d = m.where("kind = 'delete' AND old_end > old_start AND new_end = new_start")
    a = m.where("kind = 'insert' AND old_end = old_start AND new_end > new_start")
    named = lambda f, side: f.select(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in k]).alias("k"), *k, *[F.col(c).alias(f"{side}_{c}") for c in ("ix", "visible", "old_start", "old_end", "new_start", "new_end", "text_length", "item")])
    bin_ = lambda c: F.floor(c / width)
    x = named(d, "d").withColumn("bin", F.explode(F.sequence(bin_(F.col("d_old_start") - reach), bin_(F.col("d_old_end") + reach))))
    y = named(a, "a").drop(*k).withColumn("bin", bin_(F.col("a_old_start")))
    far = lambda at, start, end: F.greatest(F.lit(0), start - at, at - end)
    old = far(F.col("a_old_start"), F.col("d_old_start"), F.col("d_old_end"))
    new = far(F.col("d_new_start"), F.col("a_new_start"), F.col("a_new_end"))
    near = F.least(F.lit(FARTHEST), F.greatest(F.lit(NEAREST), F.bround(OF_TEXT * (F.col("d_text_length") + F.col("a_text_length"))))).cast("int")
    same = F.col("d_item").eqNullSafe(F.col("a_item"))
    met = x.join(y, ["k", "bin"]).withColumns({"old": old, "new": new, "near": near * F.when(same, 2).otherwise(1)})
    met = met.where((F.col("d_visible") != F.col("a_visible")) & (F.col("old") <= F.col("near")) & (F.col("new") <= F.col("near")))
    score = (F.col("old") + F.col("new") - F.when(same, SAME_ITEM).otherwise(0)).cast("int").alias("score")
    held = met.groupBy("k", *k).agg(F.collect_list(F.struct(score, F.col("d_ix").cast("int").alias("deletion"), F.col("a_ix").cast("int").alias("addition"))).alias("c"))
    return held.select(*k, F.explode(_assigned_col("c")).alias("p")).select(*k, "p.deletion", "p.addition")


def coalesce_events(events: list[tuple], length: int) -> list[tuple]:
    """The events of one item of a text pair of `length` units in all, with deletions and
    insertions that are one replacement (replacement_pairs) as one change, in the deletion's place."""
    near = 2 * min(FARTHEST, max(NEAREST, round(OF_TEXT * length)))
    far = lambda at, start, end: max(0, start - at, at - end)
    found = []
    for i, d in enumerate(events):
        for j, a in enumerate(events):
            if d[0] == "delete" and a[0] == "insert" and d[5] != a[6]:
                old, new = far(a[1], d[1], d[2]), far(d[3], a[3], a[4])
                if max(old, new) <= near:
                    found.append((old + new - SAME_ITEM, i, j))
    pairs = dict(assigned(found))
    out = []
    for i, e in enumerate(events):
        if i in pairs:
            a = events[pairs[i]]
            out.append(("change", min(e[1], a[1]), max(e[2], a[2]), min(e[3], a[3]), max(e[4], a[4]), e[5] + a[5], e[6] + a[6]))
        elif i not in pairs.values():
            out.append(e)
    return out


def hangul_word_diff(a: str, b: str, gap: float = 0.68) -> list[tuple[str, str]] | None:
    """Word pairs of two short Korean texts by cheapest alignment; None beyond 96
    characters or without words in common."""
    from ..functions.similarity import hangul_word_cost

    if max(len(a), len(b)) > 96:
        return None
    x, y = LEXERS["hangul"].findall(a), LEXERS["hangul"].findall(b)
    cost = [[j * gap for j in range(len(y) + 1)]]
    for i, u in enumerate(x):
        row = [(i + 1) * gap]
        for j, w in enumerate(y):
            row.append(min(cost[i][j] + hangul_word_cost(u, w), cost[i][j + 1] + gap, row[j] + gap))
        cost.append(row)
    i, j, out = len(x), len(y), []
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + hangul_word_cost(x[i - 1], y[j - 1]):
            i, j = i - 1, j - 1
            out.append((x[i], y[j]))
        elif i and cost[i][j] == cost[i - 1][j] + gap:
            i -= 1
            out.append((x[i], ""))
        else:
            j -= 1
            out.append(("", y[j]))
    return out[::-1] if any(p == q for p, q in out) else None


def segments(text: str, deleted: list[tuple[int, int]], inserted: list[tuple[int, int]]) -> list[tuple[str, str]]:
    """(style, text) runs: normal, delete, insert or both, spans in UTF-16 units."""
    n = utf16_len(text)
    edge = [0] * (n + 1), [0] * (n + 1)
    for kind, spans in enumerate((deleted, inserted)):
        for p, q in spans:
            edge[kind][max(0, min(p, n))] += 1
            edge[kind][max(0, min(q, n))] -= 1
    out, start, seen = [], 0, None
    depth = [0, 0]
    for i in range(n):
        depth = [depth[0] + edge[0][i], depth[1] + edge[1][i]]
        style = ("normal", "delete", "insert", "both")[(depth[0] > 0) + 2 * (depth[1] > 0)]
        if style != seen:
            if seen is not None:
                out.append((seen, _cut(text, start, i)))
            start, seen = i, style
    return [*out, (seen, _cut(text, start, n))] if n else []


segments_col = vectorized(segments, "array<struct<style:string,text:string>>")


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, overlapping and touching ones joined."""
    out: list[list[int]] = []
    for p, q in sorted(spans):
        if out and p <= out[-1][1]:
            out[-1][1] = max(q, out[-1][1])
        else:
            out.append([p, q])
    return [tuple(x) for x in out]


def compact_gaps(pairs: list[tuple[int, int]], n: int, m: int, least: int = 4, run: int = 2) -> list[tuple[str, int, int, int, int]]:
    """Gaps between anchors; with `least` gaps or more, anchors that stand in
    runs shorter than `run` are given up, so that a rewritten passage is one edit."""
    gaps = _gaps(pairs, n, m)
    if len(gaps) < least:
        return gaps
    runs: list[list[tuple[int, int]]] = []
    for p in pairs:
        if runs and (runs[-1][-1][0] + 1, runs[-1][-1][1] + 1) == p:
            runs[-1].append(p)
        else:
            runs.append([p])
    return _gaps([p for r in runs if len(r) >= run for p in r], n, m)


def preview_lines(lines: DataFrame, hunks: DataFrame, first: int = 10_000, around: int = 3) -> DataFrame:
    """Lines (pair_id, line_no) to show: the first ones and the neighbours of every hunk."""
    near = hunks.select("pair_id", F.explode(F.sequence(F.greatest(F.lit(0), F.col("after_start") - around), F.col("after_end") + around)).alias("line_no")).distinct()
    return lines.where(F.col("line_no") < first).unionByName(lines.where(F.col("line_no") >= first).join(near, ["pair_id", "line_no"], "left_semi"))


def newline_only(old_lines: Column, new_lines: Column) -> Column:
    """A replacement whose lines differ in their terminators only."""
    bare = lambda c: F.transform(c, lambda x: F.regexp_replace(x, "\r?\n$", ""))
    return (bare(old_lines) == bare(new_lines)) & (old_lines != new_lines)
