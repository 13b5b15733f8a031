"""One-to-one alignment of units, paragraphs and tables of two versions.

Exact keys are matched by equi-joins first, in Catalyst. What is left of a
comparison (a few hundred units) is one group whose scores are computed in the
group's task: comparisons are spread, and a pair never meets another's units.

The thresholds, costs and weights below are fixed values: results must agree with
those of other implementations that use them.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable
from functools import cached_property, lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import body_score, paragraph_cost, similarity_words, structure_score, title_score, token_similarity, unit_score, words_similarity
from ..functions.text import LEXERS, has_light_title, lineage_key, match_key, structure_counts, title_concept_set
from ..storage import bounded_batches, spread, trimmed

Cand = tuple[int, int, float]
GAP, MATCH_COST, NO_MATCH = 0.48, 0.94, 1.08


def greedy(cands: list[Cand], floor: float = 0.0) -> list[Cand]:
    """Best score first, ties to the closer and the lower indexes; each index once."""
    left, right, out = set(), set(), []
    for i, j, s in sorted(cands, key=lambda c: (-c[2], abs(c[0] - c[1]), c[0], c[1])):
        if s >= floor and i not in left and j not in right:
            left.add(i)
            right.add(j)
            out.append((i, j, s))
    return sorted(out)


def mutual_best(cands: list[Cand], floor: float = 0.82, margin: float = 0.10) -> list[tuple[int, int, float, bool]]:
    """(i, j, score, clear): pairs that are each other's best (ties to the lower
    index); clear: by a margin over the second best on both sides."""
    rows: dict[int, list[Cand]] = {}
    cols: dict[int, list[Cand]] = {}
    for c in cands:
        rows.setdefault(c[0], []).append(c)
        cols.setdefault(c[1], []).append(c)
    for of, other in ((rows, 1), (cols, 0)):
        for k, v in of.items():
            of[k] = heapq.nsmallest(2, v, key=lambda c: (-c[2], c[other]))
    clear = lambda v: len(v) < 2 or v[0][2] - v[1][2] >= margin
    best = (v[0] for v in rows.values() if v[0][2] >= floor)
    return sorted((*c, clear(rows[c[0]]) and clear(cols[c[1]])) for c in best if cols[c[1]][0] == c)


def cheapest(n: int, m: int, cost: Callable[[int, int], float], gap: float = GAP) -> list[tuple[int, int]]:
    """The order-preserving alignment of least cost (Needleman and Wunsch, 1970);
    of equal ways a pair is taken before a deletion, and that before an insertion."""
    row, came = [gap * j for j in range(m + 1)], [bytes([2]) * (m + 1)]
    for i in range(n):
        new, way = [row[0] + gap], bytearray([1])
        for j in range(m):
            pair, gone, come = row[j] + cost(i, j), row[j + 1] + gap, new[j] + gap
            least = min(pair, gone, come)
            new.append(least)
            way.append(0 if pair == least else 1 if gone == least else 2)
        row = new
        came.append(bytes(way))
    out, i, j = [], n, m
    while i and j:
        step = came[i][j]
        if step == 0:
            out.append((i - 1, j - 1))
        i, j = i - (step != 2), j - (step != 1)
    return out[::-1]


def paragraphs(a: list[str], b: list[str], cells: int = 250_000) -> list[tuple[int, int]]:
    """Order-preserving pairs of paragraphs that are alike; beyond `cells` pairs
    the lists are split at the middle by linear-space rows (Hirschberg, 1975)."""

    @lru_cache(maxsize=cells)
    def cost(i, j):
        return paragraph_cost(1.0 if a[i] == b[j] else token_similarity(a[i], b[j]))

    def rows(i0, i1, j0, j1, back):
        row = [GAP * k for k in range(j1 - j0 + 1)]
        for i in range(i1 - 1, i0 - 1, -1) if back else range(i0, i1):
            new = [row[0] + GAP]
            for k in range(1, j1 - j0 + 1):
                new.append(min(row[k - 1] + cost(i, j1 - k if back else j0 + k - 1), row[k] + GAP, new[k - 1] + GAP))
            row = new
        return row

    def solve(i0, i1, j0, j1):
        if i0 == i1 or j0 == j1:
            return []
        if (i1 - i0) * (j1 - j0) <= cells or i1 - i0 == 1:
            return [(i0 + i, j0 + j) for i, j in cheapest(i1 - i0, j1 - j0, lambda i, j: cost(i0 + i, j0 + j))]
        mid = (i0 + i1) // 2
        up, down = rows(i0, mid, j0, j1, False), rows(mid, i1, j0, j1, True)
        cut = min(range(j1 - j0 + 1), key=lambda k: up[k] + down[j1 - j0 - k])
        return solve(i0, mid, j0, j0 + cut) + solve(mid, i1, j0 + cut, j1)

    return solve(0, len(a), 0, len(b))


def longest_increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Most pairs that keep order on both sides (patience sorting)."""
    pairs = sorted(pairs, key=lambda p: (p[0], -p[1]))
    tails, at, back = [], [], []
    for k, (_, y) in enumerate(pairs):
        i = bisect_left(tails, y)
        back.append(at[i - 1] if i else -1)
        if i == len(tails):
            tails.append(y)
            at.append(k)
        else:
            tails[i], at[i] = y, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


# ---------------------------------------------------------------- units


class Units:
    """One side's units with their keys."""

    def __init__(self, frame: pd.DataFrame | dict[str, list]):
        size = len(frame["kind"]) if isinstance(frame, dict) else len(frame)
        get = lambda c: [x if isinstance(x, str) else "" for x in frame[c]] if c in frame else [""] * size
        self.kind, self.title, self.body, self.number = get("kind"), get("title"), get("body"), [x.lower() for x in get("number")]

    # Keys are made when a score first asks for them: texts without articles are matched by their words alone.
    title_key = cached_property(lambda self: [lineage_key(x) for x in self.title])
    body_key = cached_property(lambda self: [lineage_key(x) for x in self.body])
    concepts = cached_property(lambda self: [title_concept_set(x) for x in self.title])
    words = cached_property(lambda self: [set(LEXERS["words"].findall(x.lower())) for x in self.body])
    counts = cached_property(lambda self: [structure_counts(x) for x in self.body])
    light = cached_property(lambda self: [has_light_title(x) for x in self.title])

    def of(self, *kinds: str) -> list[int]:
        return [i for i, k in enumerate(self.kind) if k in kinds]


class Evidence:
    """Scores of pairs of articles, computed when they are first asked for."""

    def __init__(self, a: Units, b: Units):
        self.a, self.b = a, b
        self.rows, self.cols = a.of("article"), b.of("article")
        self.title = lru_cache(maxsize=None)(self._title)
        self.body = lru_cache(maxsize=None)(lambda i, j: body_score(a.body_key[i], b.body_key[j], a.words[i], b.words[j]))
        repeated = lambda u, at: {k for k, n in Counter(u.body_key[i] for i in at).items() if k and n > 1}
        self.repeated = repeated(a, self.rows) | repeated(b, self.cols)
        self.best_row = {i: max((self.title(i, j) for j in self.cols), default=0.0) for i in self.rows}
        self.best_col = {j: max((self.title(i, j) for i in self.rows), default=0.0) for j in self.cols}

    def _title(self, i, j):
        return title_score(self.a.title_key[i], self.b.title_key[j], self.a.concepts[i], self.b.concepts[j])

    def same(self, i, j) -> bool:
        return self.a.number[i] == self.b.number[j]

    def lineage(self, i, j) -> float:
        titled = bool(self.a.title_key[i] and self.b.title_key[j])
        return unit_score(self.title(i, j), self.body(i, j), structure_score(self.a.counts[i], self.b.counts[j]), self.same(i, j), titled)

    def adjusted(self, i, j) -> tuple[float, float, bool]:
        """(score, title score, ambiguous). Titles that say little prove little
        without an equal number or an alike body, and a repeated body, or one whose
        titles fit better elsewhere, proves little against unlike titles."""
        title, body, score = self.title(i, j), self.body(i, j), self.lineage(i, j)
        weak = title >= 0.82 and self.a.light[i] and self.b.light[j] and not self.same(i, j) and body < 0.72
        if weak:
            title = min(title, 0.34)
        conflict = bool(self.a.title[i] and self.b.title[j]) and title < 0.35
        key = self.a.body_key[i]
        repeated = key == self.b.body_key[j] and key in self.repeated
        fits_elsewhere = any(t >= 0.72 and t >= title + 0.20 for t in (self.best_row[i], self.best_col[j]))
        ambiguous = weak or (conflict and body >= 0.84 and (repeated or fits_elsewhere))
        return (min(score, 0.42) if ambiguous else score), title, ambiguous

    def anchors(self) -> list[Cand]:
        """Pairs whose titles are each other's best, clearly so or as the only equal ones."""
        a, b = self.a, self.b
        once = lambda u, at: {k for k, n in Counter(u.title_key[i] for i in at).items() if k and n == 1}
        only = once(a, self.rows) & once(b, self.cols)
        out = []
        for i, j, s, clear in mutual_best([(i, j, self.title(i, j)) for i in self.rows for j in self.cols]):
            if not (a.title[i] and b.title[j]):
                continue
            exact = a.title_key[i] == b.title_key[j] and a.title_key[i] in only
            if (clear or exact) and (not (a.light[i] and b.light[j]) or self.same(i, j) or self.body(i, j) >= 0.72):
                out.append((i, j, s))
        return out


def _articles(a: Units, b: Units) -> dict[int, tuple[int, float, str]]:
    """old index -> (new index, score, mode) of articles."""
    e = Evidence(a, b)
    found = {i: (j, max(s, e.lineage(i, j)), "same" if e.same(i, j) else "moved") for i, j, s in e.anchors()}
    used = {j for j, _, _ in found.values()}
    rows, cols = [i for i in e.rows if i not in found], [j for j in e.cols if j not in used]

    def cost(x, y):
        s = e.adjusted(rows[x], cols[y])[0]
        return (MATCH_COST * (1 - s) if s >= 0.43 else NO_MATCH) - (0.015 if e.same(rows[x], cols[y]) else 0.0)

    for x, y in cheapest(len(rows), len(cols), cost):
        i, j = rows[x], cols[y]
        if (s := e.adjusted(i, j)[0]) >= 0.43:
            found[i] = (j, s, "same" if e.same(i, j) else "renumbered")
            used.add(j)
    moves = []
    for i in e.rows:
        for j in e.cols if i not in found else ():
            if j in used:
                continue
            s, title, ambiguous = e.adjusted(i, j)
            body = e.body(i, j)
            if s >= 0.70 or title >= 0.82 or (title >= 0.68 and body >= 0.48) or (not ambiguous and body >= 0.84):
                moves.append((s + 0.10 * title + 0.04 * body, i, j, s))
    for _, i, j, s in sorted(moves, key=lambda c: -c[0]):
        if i not in found and j not in used:
            found[i] = (j, s, "moved")
            used.add(j)
    crossed = _crossed(found)
    return {i: (j, s, "moved" if i in crossed else m) for i, (j, s, m) in found.items()}


def _crossed(found: dict[int, tuple]) -> set[int]:
    """Old indexes of pairs that cross another pair."""
    order = sorted((i, v[0]) for i, v in found.items())
    out, high, low = set(), -1, float("inf")
    for i, j in order:
        if j < high:
            out.add(i)
        high = max(high, j)
    for i, j in reversed(order):
        if j > low:
            out.add(i)
        low = min(low, j)
    return out


def _others(a: Units, b: Units) -> dict[int, tuple[int, float, str]]:
    """Preambles, sections and blocks beside articles, in order, kind by kind."""
    skip = ("article", "cell")
    rows, cols = [i for i, k in enumerate(a.kind) if k not in skip], [j for j, k in enumerate(b.kind) if k not in skip]

    @lru_cache(maxsize=None)
    def score(x, y):
        """(score, least score that counts)."""
        i, j = rows[x], cols[y]
        if a.kind[i] != b.kind[j]:
            return 0.0, 2.0
        text = lambda u, k: f"{u.title[k]}\n{u.body[k]}"
        s = token_similarity(text(a, i), text(b, j))
        if a.kind[i] != "section":
            return s, 0.48
        if a.number[i] == b.number[j]:
            return max(s, 0.88), 0.30
        return (max(s, 0.70 * token_similarity(a.title[i], b.title[j])) if a.title[i] and b.title[j] else s), 0.48

    ok = lambda x, y: score(x, y)[0] >= score(x, y)[1]
    pairs = cheapest(len(rows), len(cols), lambda x, y: MATCH_COST * (1 - score(x, y)[0]) if ok(x, y) else NO_MATCH)
    return {rows[x]: (cols[y], score(x, y)[0], "same") for x, y in pairs if ok(x, y)}


def generic_pairs(old: list[str], new: list[str], pairs: int = 1_000_000) -> list[Cand]:
    """Texts without articles, by words: a pair counts from 0.48 on, ranked by its
    score and a little by its place. Each old text tries its best pair in rank
    order only, so one whose best is taken stays alone; beyond `pairs` candidate
    pairs it tries its best free one instead, from a queue of one pair a text."""
    n, m = len(old), len(new)
    words = [[similarity_words(x) for x in side] for side in (old, new)]
    sizes = [[len(x) for x in side] for side in words]
    uses: dict[str, list[tuple[int, int]]] = {}
    for j, x in enumerate(words[1]):
        for w, c in Counter(x).items():
            uses.setdefault(w, []).append((j, c))
    empty = [j for j in range(m) if not sizes[1][j]]

    def candidates(i):
        """Pairs of an old text that count, by new texts: only those that share words can,
        or that have none either."""
        shared: dict[int, int] = {}
        for w, c in Counter(words[0][i]).items():
            for j, d in uses.get(w, ()):
                shared[j] = shared.get(j, 0) + (c if c < d else d)
        for j in sorted(shared) if sizes[0][i] else empty:
            if old[i] == new[j]:
                s = 1.0
            elif sizes[0][i] and shared[j] < 0.24 * (sizes[0][i] + sizes[1][j]):
                continue  # no order of the words could reach the floor
            else:
                s = words_similarity(words[0][i], words[1][j])
            if s >= 0.48:
                yield s + (1 - min(abs(i - j) / max(n, m, 1), 1.0)) * 0.015, i, j, s

    tried, taken, out = set(), set(), []
    if n * m <= pairs:
        ranked = sorted((c for i in range(n) for c in candidates(i)), key=lambda c: -c[0])
        for _, i, j, s in ranked:
            if i not in tried:
                tried.add(i)
                if j not in taken:
                    taken.add(j)
                    out.append((i, j, s))
        return sorted(out)
    best = lambda i: min(((-c[0], i, c[2], c[3]) for c in candidates(i) if c[2] not in taken), default=None)
    queue = [c for i in range(n) if (c := best(i))]
    heapq.heapify(queue)
    while queue:
        _, i, j, s = heapq.heappop(queue)
        if j in taken:
            if c := best(i):
                heapq.heappush(queue, c)
            continue
        taken.add(j)
        out.append((i, j, s))
    return sorted(out)


def align_units(old: pd.DataFrame | dict[str, list], new: pd.DataFrame | dict[str, list]) -> list[tuple[int, int, float, str]]:
    """(old index, new index, score, mode) of the units of two versions (frames, or lists
    by column); mode: same, renumbered or moved.

    Where both versions have articles these are matched by titles, then in order,
    then as moves, and what stands beside them in order; otherwise all texts are
    matched by their words. Cells of tables only meet cells: tables by the cells
    they share, rows by unique equal rows and gaps of one size."""
    a, b = Units(old), Units(new)
    if a.of("article") and b.of("article"):
        found = _articles(a, b) | _others(a, b)
    else:
        rows, cols = [i for i, k in enumerate(a.kind) if k != "cell"], [j for j, k in enumerate(b.kind) if k != "cell"]
        found = {rows[i]: (cols[j], s, "same") for i, j, s in generic_pairs([a.body[i] for i in rows], [b.body[j] for j in cols])}
    found |= _cells(old, new)
    return [(i, *found[i]) for i in sorted(found)]


def _cells(old: pd.DataFrame | dict[str, list], new: pd.DataFrame | dict[str, list]) -> dict[int, tuple[int, float, str]]:
    """Cells by their place (table, row, col) in matched rows of matched tables."""
    if not all({"table", "row", "col"} <= set(f) for f in (old, new)):
        return {}

    def tables(frame):
        out: dict = {}
        for i, (kind, table, row, col, body) in enumerate(zip(*(frame[c] for c in ("kind", "table", "row", "col", "body")))):
            if kind == "cell" and table == table and table is not None:
                out.setdefault(int(table), {}).setdefault(int(row), {})[int(col)] = (i, body if isinstance(body, str) else "")
        return [[[t[r][c] for c in sorted(t[r])] for r in sorted(t)] for _, t in sorted(out.items())]

    x, y = tables(old), tables(new)
    plain = lambda ts: [{"rows": [[text for _, text in r] for r in t]} for t in ts]
    pairs, rows = match_tables(plain(x), plain(y))
    out = {}
    for i, j, _ in pairs:
        for p, q in rows[i, j]:
            for (u, old_text), (v, new_text) in zip(x[i][p], y[j][q]):
                out[u] = (v, 1.0 if old_text == new_text else token_similarity(old_text, new_text), "same")
    return out


MATCH = "old_ix int, new_ix int, score double, mode string"
#: What match_units() reads of a unit, where it is there.
UNIT_COLUMNS = ("unit_ix", "kind", "number", "title", "body", "table", "row", "col")


def match_units(units: DataFrame, keys: tuple[str, ...] = ("comparison_id",), side: str = "doc_ord") -> DataFrame:
    """(keys, old_ix, new_ix, score, mode) of units (keys, doc_ord 0 or 1, unit_ix,
    kind, number, title, body, and for cells table, row, col). A comparison whose
    two sides are equal is matched by a join; the others are groups of one
    comparison each. The units are read once."""
    k, cols = list(keys), [c for c in UNIT_COLUMNS if c in units.columns]
    text = F.concat_ws("\u0001", *[F.coalesce(c, F.lit("")) for c in ("kind", "number", "title", "body")])
    unit = F.struct(*cols)
    sides = spread(units.withColumn("__h", F.xxhash64(text)), *k).groupBy(*k).agg(
        *[F.sort_array(F.collect_list(F.when(F.col(side) == i, unit))).alias(n) for i, n in enumerate(("old", "new"))],
        *[F.sort_array(F.collect_list(F.when(F.col(side) == i, F.struct("unit_ix", "__h")))).alias(f"h{i}") for i in (0, 1)],
    )
    equal = (F.col("h0") == F.col("h1")) & (F.size("h0") > 0)
    same = sides.where(equal).select(*k, F.explode("old").alias("u")).select(*k, F.col("u.unit_ix").alias("old_ix"), F.col("u.unit_ix").alias("new_ix"), F.lit(1.0).alias("score"), F.lit("same").alias("mode"))
    rest = sides.where(~equal & (F.size("h0") > 0) & (F.size("h1") > 0)).select(*k, "old", "new")
    schema = ", ".join([f"`{c}` {dict(units.dtypes)[c]}" for c in k] + [MATCH])
    fields = [("old_ix", pa.int32()), ("new_ix", pa.int32()), ("score", pa.float64()), ("mode", pa.string())]

    def run(batches):
        for b in batches:
            at, found = [], []
            for n in range(b.num_rows):
                # Plain lists of one comparison at a time: a batch as objects would be many times its bytes.
                old, new = (dict(zip(cols, (c.to_pylist() for c in b.column(s)[n].values.flatten()))) for s in ("old", "new"))
                for i, j, s, m in align_units(old, new):
                    at.append(n)
                    found.append((old["unit_ix"][i], new["unit_ix"][j], s, m))
            made = [pa.array(x, t) for x, (_, t) in zip(zip(*found) if found else [()] * len(fields), fields)]
            yield pa.RecordBatch.from_arrays([b.column(c).take(pa.array(at, pa.int64())) for c in k] + made, names=[*k, *[f for f, _ in fields]])
        trimmed()

    bounded_batches(units.sparkSession)
    return same.unionByName(rest.mapInArrow(run, schema))


def unique_titles(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("comparison_id",)) -> DataFrame:
    """(keys, old_ix, new_ix): articles whose equal title stands once on each side,
    by an equi-join; no unit is scored. Units are (keys, unit_ix, kind, title)."""
    from ..functions.text import lineage_key_col, low_information_title

    k = list(keys)

    def once(df, name):
        titled = df.where((F.col("kind") == "article") & ~low_information_title(F.coalesce("title", F.lit("")))).withColumn("t", lineage_key_col(F.coalesce("title", F.lit("")))).where("t <> ''")
        return titled.groupBy(*k, "t").agg(F.count("*").alias("n"), F.min("unit_ix").alias(name)).where("n = 1").drop("n")

    return once(old, "old_ix").join(once(new, "new_ix"), [*k, "t"]).select(*k, "old_ix", "new_ix")


def match_tables(old: list[dict], new: list[dict]) -> tuple[list[Cand], dict[tuple[int, int], list[tuple[int, int]]]]:
    """Tables by shared cell keys (a sole pair always), then their rows: unique
    equal rows first, then gaps of equal length by position.

    A table is {"rows": [[cell text, ...], ...]}."""
    keys = lambda t: {match_key(c) for r in t["rows"] for c in r} - {""}
    cands = []
    for i, a in enumerate(old):
        for j, b in enumerate(new):
            x, y = keys(a), keys(b)
            s = len(x & y) / max(len(x), len(y)) if x or y else 0.0
            if s >= 0.2 or len(old) == len(new) == 1:
                cands.append((i, j, s + (0.01 if i == j else 0)))
    tables, rows = greedy(cands), {}
    for i, j, _ in tables:
        a, b = ([tuple(match_key(c) for c in r) for r in t["rows"]] for t in (old[i], new[j]))
        unique = [(p, b.index(r)) for p, r in enumerate(a) if a.count(r) == 1 and b.count(r) == 1]
        anchors, out = longest_increasing(unique), []
        for (p, q), (r, s) in zip([(-1, -1), *anchors], [*anchors, (len(a), len(b))]):
            if r - p == s - q:
                out += [(p + k, q + k) for k in range(1, r - p)]
            if r < len(a):
                out.append((r, s))
        rows[i, j] = sorted(set(out) | set(unique))
    return tables, rows


# ---------------------------------------------------------------- three versions


def grid(bases: DataFrame, matches: DataFrame, additions: DataFrame, keys: tuple[str, ...] = ("comparison_id",), units: DataFrame | None = None) -> DataFrame:
    """(keys, row_id, base_ix, other_ix, doc): the base's units in order, each
    with its matches, and units that only another version has after the last
    unit before them that the base has.

    bases (keys, unit_ix); matches (keys, doc, base_ix, other_ix); additions
    (keys, doc, unit_ix): all units of the other versions. With units (keys, doc,
    unit_ix, kind, number, title, body) of the other versions too, rows are shared:
    a base unit and its matches have one row_id, and so have units of several versions
    at one place that are alike (merged_additions). Without, each match is a row."""
    k = list(keys)
    rows = bases.select(*k, F.col("unit_ix").alias("base_ix")).join(matches, [*k, "base_ix"], "left").select(*k, F.col("base_ix").alias("slot"), F.lit(0).alias("added"), "base_ix", "other_ix", "doc")
    lone = additions.join(matches.select(*k, "doc", F.col("other_ix").alias("unit_ix"), "base_ix"), [*k, "doc", "unit_ix"], "left")
    w = Window.partitionBy(*k, "doc").orderBy("unit_ix")
    lone = lone.withColumn("slot", F.coalesce(F.last("base_ix", ignorenulls=True).over(w), F.lit(-1))).where("base_ix IS NULL").select(*k, "slot", "doc", "unit_ix")
    order, number = ["slot", "added", "doc", "other_ix"], F.row_number
    if units is None:
        lone = lone.withColumn("added", F.lit(1))
    else:
        merged = merged_additions(lone.join(units.select(*k, "doc", "unit_ix", "kind", "number", "title", "body"), [*k, "doc", "unit_ix"]), keys)
        lone = lone.drop("slot").join(merged.withColumnRenamed("row", "added"), [*k, "doc", "unit_ix"])
        order, number = order[:2], F.dense_rank
    lone = lone.select(*k, "slot", "added", F.lit(None).cast("int").alias("base_ix"), F.col("unit_ix").alias("other_ix"), "doc")
    return rows.unionByName(lone).withColumn("row_id", number().over(Window.partitionBy(*k).orderBy(*order))).select(*k, "row_id", "base_ix", "other_ix", "doc")


def nth_occurrence_join(left: DataFrame, right: DataFrame, key: str, order: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """The n-th row of a text key with the n-th one of the other side. Rows are
    numbered and joined by a hash of the key, its text is compared at the end."""
    w = Window.partitionBy(*keys, "__h").orderBy(order)
    n = lambda df: df.withColumn("__h", F.sha2(F.col(key), 256)).withColumn("nth", F.row_number().over(w))
    other = n(right).withColumnRenamed(order, f"{order}_right").drop(key)
    return n(left).join(other, [*keys, "__h", "nth"]).drop("__h")


def vote_map(pairs: DataFrame, keys: tuple[str, ...], old: str, new: str) -> DataFrame:
    """(keys, old, new, votes): containers by majority of their matched members,
    each the other's first choice."""
    votes = pairs.groupBy(*keys, old, new).agg(F.count("*").alias("votes"))
    best = lambda own, other: F.row_number().over(Window.partitionBy(*keys, own).orderBy(F.col("votes").desc(), other))
    return votes.withColumn("a", best(old, new)).withColumn("b", best(new, old)).where("a = 1 AND b = 1").drop("a", "b")


def merged_additions(additions: DataFrame, keys: tuple[str, ...] = ("comparison_id",), least: float = 0.84) -> DataFrame:
    """(keys, slot, row, doc, unit_ix): units that only other versions have (keys,
    slot, doc, unit_ix, kind, number, title, body), of which two of different
    versions at one slot share a row if they are alike: a lineage score of `least`,
    and equal numbers, alike titles, or alike bodies. Best pairs first."""
    k = list(keys)
    cols = ["doc", "unit_ix", "kind", "number", "title", "body"]
    schema = ", ".join([f"`{c}` {dict(additions.dtypes)[c]}" for c in (*k, "slot")] + ["row int", "doc int", "unit_ix int"])

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["doc", "unit_ix"]).reset_index(drop=True)
        u = Units(g.assign(kind="article"))
        e = Evidence(u, u)
        near = lambda i, j: e.lineage(i, j) >= least and (e.same(i, j) or e.title(i, j) >= 0.82 or e.body(i, j) >= 0.72)
        cands = [(i, j, e.lineage(i, j)) for i in range(len(g)) for j in range(i + 1, len(g)) if g.doc[i] < g.doc[j] and near(i, j)]
        first, held = list(range(len(g))), [{g.doc[i]} for i in range(len(g))]
        for i, j, _ in sorted(cands, key=lambda c: (-c[2], c[0], c[1])):
            p, q = first[i], first[j]
            if p != q and not held[p] & held[q]:
                held[min(p, q)] |= held[max(p, q)]
                first = [min(p, q) if x in (p, q) else x for x in first]
        order = {x: n for n, x in enumerate(dict.fromkeys(sorted(first)), 1)}
        return pd.DataFrame({**{c: g[c] for c in (*k, "slot")}, "row": [order[x] for x in first], "doc": g.doc, "unit_ix": g.unit_ix})

    return spread(additions.select(*k, "slot", *cols), *k, "slot").groupBy(*k, "slot").applyInPandas(run, schema)


def greedy_votes(pairs: DataFrame, keys: tuple[str, ...], old: str, new: str) -> DataFrame:
    """(keys, old, new, votes): containers by the votes of their matched members, the
    most votes first and each container once. Votes are counted before they are
    grouped, so a group is the containers of one comparison."""
    k = list(keys)
    votes = pairs.groupBy(*k, old, new).agg(F.count("*").alias("votes"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        left, right, kept = set(), set(), []
        for n, r in enumerate(g.sort_values(["votes", old, new], ascending=[False, True, True]).itertuples(index=False)):
            a, b = getattr(r, old), getattr(r, new)
            if a not in left and b not in right:
                left.add(a)
                right.add(b)
                kept.append(r)
        return pd.DataFrame(kept, columns=g.columns)

    return votes.groupBy(*k).applyInPandas(run, votes.schema)


def paragraph_anchors(old: list[str], new: list[str], hints: list[tuple[int, int]] = ()) -> list[tuple[int, int]]:
    """Certain pairs of paragraphs, in order on both sides: those that stand once with
    an equal key, and hints (pairs known from elsewhere) of equal texts."""
    a, b = [match_key(x) for x in old], [match_key(x) for x in new]
    once = {k for k, n in Counter(a).items() if n == 1 and k} & {k for k, n in Counter(b).items() if n == 1}
    where = {k: j for j, k in enumerate(b)}
    pairs = {(i, where[k]) for i, k in enumerate(a) if k in once} | {(i, j) for i, j in hints if a[i] == b[j]}
    return longest_increasing(list(pairs))
