"""Matching of the list items of two bodies.

Items are (label, family, ordinal, level, parent, core) in order; a text without a
label is a body item. Stages go from certain to loose, each on what the one before
left over; within a level parents come first. One pair of bodies is one row, and
pairs are spread by their rows. Bodies of any length go through all stages: pairs of
items are looked at one by one and not listed, KEPT candidates of an item and
SCORES scores are held at a time, and a pair is scored only if its letters and words
allow it what is asked.

The thresholds and weights are fixed values: results must agree with those of
other implementations that use them.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter, namedtuple
from functools import lru_cache
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import _units, part_score, share_of_sets
from ..functions.text import LEXERS, lineage_key, match_key, stable_edge
from ..functions.vectorized import vectorized
from ..storage import spread

Item = namedtuple("Item", "label family ordinal level parent core")
Pair = tuple[int, int, float]
#: Candidates of an item and scores of a comparison that are held at a time; what is dropped is made again.
KEPT, SCORES = 64, 1 << 16
_HEAD = re.compile(r"^\s*[\"“‘'「『]([^\"”’'」』]{1,80})[\"”’'」』]")


class Lists:
    """Two lists of items, what is matched so far, and scores on demand."""

    def __init__(self, old: list[Item], new: list[Item]):
        self.old, self.new = old, new
        self.keys = [lineage_key(x.core) for x in old], [lineage_key(x.core) for x in new]
        self.texts = [match_key(x.core) for x in old], [match_key(x.core) for x in new]
        words = lambda t: set(w.lower() for w in LEXERS["boundary"].findall(t))
        self.words = [words(x.core) for x in old], [words(x.core) for x in new]
        heads = lambda side: [m.group(1) if (m := _HEAD.match(x.core)) else "" for x in side]
        self.heads = heads(old), heads(new)
        self.found: dict[int, tuple[int, float]] = {}
        self.taken: set[int] = set()
        self.letters = [[Counter(_units(k)) for k in side] for side in self.keys]
        self.sizes = [[c.total() for c in side] for side in self.letters]
        self.ordinal_rows, self.label_rows = ([self._rows(s, n) for s in (old, new)] for n in ("ordinal", "label"))
        self.score = lru_cache(maxsize=SCORES)(self._score)

    def _score(self, i, j):
        a, b = self.old[i], self.new[j]
        return part_score(self.keys[0][i], self.keys[1][j], self.words[0][i], self.words[1][j], bool(a.label) and a.label == b.label)

    def reaches(self, i, j, least):
        """Whether the score is `least` or more; often words tell, before characters are compared."""
        jac, con = share_of_sets(self.words[0][i], self.words[1][j])
        known = bool(self.keys[0][i] and self.keys[1][j]) and max(0.32 * jac, 0.90 * con) >= least
        return known or self.score(i, j) >= least

    def contained(self, i, j):
        return share_of_sets(self.words[0][i], self.words[1][j])[1]

    def edge(self, i, j):
        return stable_edge(self.texts[0][i], self.texts[1][j])

    def rank(self, i, j):
        return max(self.score(i, j), 0.94 * self.contained(i, j))

    def take(self, i, j, score):
        if i not in self.found and j not in self.taken:
            self.found[i] = (j, score)
            self.taken.add(j)

    def bound(self, i, j):
        """What the score is at most: matching blocks hold no letter more often than both sides do."""
        a, b = self.keys[0][i], self.keys[1][j]
        if not a or not b or a == b:
            return float(a == b != "")
        jac, con = share_of_sets(self.words[0][i], self.words[1][j])
        alike = 2 * (self.letters[0][i] & self.letters[1][j]).total() / (self.sizes[0][i] + self.sizes[1][j])
        same = bool(self.old[i].label) and self.old[i].label == self.new[j].label
        return min(1.0, max(0.68 * alike + 0.32 * jac, 0.90 * con) + (0.08 if same else 0.0))

    def free(self, level=None, labelled=None):
        """Indices of unmatched items of both sides, of one level, with labels or without."""
        fit = lambda x: (level is None or x.level == level) and (labelled is None or bool(x.label) == labelled)
        return [i for i, x in enumerate(self.old) if i not in self.found and fit(x)], [j for j, y in enumerate(self.new) if j not in self.taken and fit(y)]

    def below(self, level):
        """(old, function): unmatched items of a level with labels, and the new ones below the same parent."""
        left, right = self.free(level, True)
        cols: dict[int, list[int]] = {}
        for j in right:
            cols.setdefault(self.new[j].parent, []).append(j)
        parent = lambda i: self.old[i].parent if self.old[i].parent < 0 else self.found.get(self.old[i].parent, (None,))[0]
        return left, lambda i: cols.get(parent(i), ())

    def parents_match(self, p, q):
        return p == q if p < 0 or q < 0 else self.found.get(p, (None,))[0] == q

    def under_matched(self, i, j):
        return self.parents_match(self.old[i].parent, self.new[j].parent)

    def one_layer_lost(self, i, j):
        """One item lies a level deeper, below a parent that the other side lacks."""
        x, y = self.old[i], self.new[j]
        if x.level == y.level + 1:
            return x.parent >= 0 and x.parent not in self.found and self.parents_match(self.old[x.parent].parent, y.parent)
        if y.level == x.level + 1:
            return y.parent >= 0 and y.parent not in self.taken and self.parents_match(x.parent, self.new[y.parent].parent)
        return False

    def children(self) -> Counter:
        """How many matched items lie below each pair of items."""
        return Counter((self.old[p].parent, self.new[q].parent) for p, (q, _) in self.found.items())

    @staticmethod
    def _rows(side, name):
        """Of each item the row of labels of its siblings of its family, or of the ordinals of its labelled siblings."""
        key = lambda x: (x.level, x.parent, x.family if name == "label" else None)
        rows: dict[tuple, list] = {}
        for x in side:
            if name == "label" or x.label:
                rows.setdefault(key(x), []).append(getattr(x, name))
        rows = {k: tuple(v) for k, v in rows.items()}
        return [rows.get(key(x), ()) for x in side]

    def ordinal_shape(self, i, j):
        """Both stand among labelled siblings with the same row of ordinals."""
        rows = self.ordinal_rows[0][i], self.ordinal_rows[1][j]
        return self.old[i].level == self.new[j].level and len(rows[0]) > 1 and rows[0] == rows[1] and None not in rows[0]

    def label_shape(self, i, j):
        """Both stand among siblings of a family with the same row of labels."""
        return self.old[i].level == self.new[j].level and self.label_rows[0][i] == self.label_rows[1][j]


def _move_rank(s, c, k):
    return max(s, 0.94 * c) + min(0.12, 0.06 * k) if s >= 0.74 or c >= 0.88 or k >= 2 or (k and s >= 0.55) else None


def _across_rank(s, c, o, e):
    return max(s, 0.94 * c) + (0.08 if o else 0.0) if (o and (s >= 0.34 or c >= 0.50 or e)) or s >= 0.74 or c >= 0.86 else None


def _move_worth(rank, s):
    return max(s, rank)


def _across_worth(rank, s):
    return max(s, 0.56)


def select_moves(cands: list[tuple[int, int, float, float, int]]) -> list[Pair]:
    """(old, new, similarity, containment, matched children): best rank first."""
    return _best_listed(cands, _move_rank, _move_worth)


def select_across(cands: list[tuple[int, int, float, float, bool, bool]]) -> list[Pair]:
    """(old, new, similarity, containment, same ordinal, edge), a level apart."""
    return _best_listed(cands, _across_rank, _across_worth)


def _best_listed(cands, rank, worth) -> list[Pair]:
    rows: dict[int, list] = {}
    for c in cands:
        if (r := rank(*c[2:])) is not None:
            rows.setdefault(c[0], []).append((r, c[1], c[2]))
    return _best_first(rows, rows.__getitem__, worth)


def _best_first(left, candidates, worth) -> list[Pair]:
    """One-to-one pairs of the best rank, ties to the nearer one, then to the earlier.

    candidates(i) gives (rank, j, score) of an old item, the same ones each time: KEPT of
    them are held, and when all of these are taken the next ones are asked for."""
    held, whole, heap, right, out = {}, {}, [], set(), []

    def ask(i):
        while True:
            if i not in held:
                best = heapq.nsmallest(KEPT, ((-rank, abs(i - j), j, s) for rank, j, s in candidates(i) if j not in right))
                held[i], whole[i] = best[::-1], len(best) < KEPT
            while held[i] and held[i][-1][2] in right:
                held[i].pop()
            if held[i] or whole[i]:
                break
            del held[i]
        if held[i]:
            rank, away, j, s = held[i][-1]
            heapq.heappush(heap, (rank, away, i, j, s))

    for i in left:
        ask(i)
    while heap:
        rank, _, i, j, s = heapq.heappop(heap)
        if j in right:
            ask(i)
        else:
            right.add(j)
            out.append((i, j, worth(-rank, s)))
            held[i] = []
    return out


def _each_first_choice(cands, better, accept, worth) -> list[Pair]:
    """Candidates by old items in order; each asks its best free one only, shape before rank."""
    right, out = set(), []
    for i, row in groupby(cands, lambda c: c[0]):
        best = max((c for c in row if c[1] not in right), key=better, default=None)
        if best and accept(best):
            right.add(best[1])
            out.append((i, best[1], worth(best)))
    return out


def select_same_ordinal(cands: list[tuple[int, int, float, float, bool, bool]]) -> list[Pair]:
    """(old, new, similarity, containment, shape, edge)."""
    return _each_first_choice(cands, lambda c: (c[4], max(c[2], 0.94 * c[3])), lambda c: (c[4] and (c[2] >= 0.20 or c[3] >= 0.35 or c[5])) or c[2] >= 0.62 or c[3] >= 0.76, lambda c: max(c[2], 0.58 if c[4] else 0.52))


def select_same_label(cands: list[tuple[int, int, float, bool, bool]]) -> list[Pair]:
    """(old, new, similarity, shape, edge)."""
    return _each_first_choice(cands, lambda c: (c[3], c[2]), lambda c: c[3] or c[2] >= 0.18 or c[4], lambda c: max(c[2], 0.52))


def exact_pairs(old: list[str], new: list[str]) -> list[tuple[int, int]]:
    """Equal keys: old ones in order, each with the nearest unused one, ties to the lower index."""
    where: dict[str, list[int]] = {}
    for j, k in enumerate(new):
        where.setdefault(k, []).append(j)
    out = []
    for i, k in enumerate(old):
        if k and where.get(k):
            j = min(where[k], key=lambda y: (abs(i - y), y))
            where[k].remove(j)
            out.append((i, j))
    return out


def match_parts(old: list[Item], new: list[Item], scored: bool = True) -> list[Pair]:
    """(old, new, score) of two bodies' items, however many they are.

    If not `scored`, the pairs are the same, but sole items without labels may have a
    score of 0.50 instead of theirs."""
    lists = Lists(old, new)
    listed = [sum(bool(x.label) for x in s) for s in (old, new)]
    if (listed[0] >= 2 and not listed[1]) or (listed[1] >= 2 and not listed[0]):  # a list against prose: the lead texts at most
        bodies = [[k for k, x in enumerate(s) if not x.label] for s in (old, new)]
        if len(bodies[0]) == len(bodies[1]) == 1:
            i, j = bodies[0][0], bodies[1][0]
            s = lists.score(i, j)
            if s >= 0.32 or lists.texts[0][i] == lists.texts[1][j]:
                return [(i, j, max(s, 0.50))]
        return []
    for i, j in exact_pairs(*lists.keys):
        lists.take(i, j, 1.0)
    headed: dict[str, list[int]] = {}
    for j in lists.free()[1]:
        headed.setdefault(lists.heads[1][j], []).append(j)
    for i in lists.free()[0]:
        same = [j for j in headed.get(lists.heads[0][i], ()) if lists.heads[0][i] and j not in lists.taken]
        if same:
            j = max(same, key=lambda j: (lists.score(i, j), -abs(i - j), -j))
            lists.take(i, j, max(lists.score(i, j), 0.90))
    for level in range(1, 5):
        left, below = lists.below(level)
        kids = lists.children()

        def moves(i):
            for j in below(i):
                c, k = lists.contained(i, j), kids[i, j]
                if old[i].label != new[j].label and _move_rank(lists.bound(i, j), c, k) is not None:
                    s = lists.score(i, j)
                    if (rank := _move_rank(s, c, k)) is not None:
                        yield rank, j, s

        _taken(lists, _best_first(left, moves, _move_worth))
        left, below = lists.below(level)
        ordinals = ((i, j, lists.score(i, j), lists.contained(i, j), lists.ordinal_shape(i, j), lists.edge(i, j)) for i in left if old[i].ordinal is not None for j in below(i) if old[i].ordinal == new[j].ordinal and old[i].label != new[j].label)
        _taken(lists, select_same_ordinal(ordinals))
        left, below = lists.below(level)
        labels = ((i, j, lists.score(i, j), lists.label_shape(i, j), lists.edge(i, j)) for i in left for j in below(i) if old[i].label == new[j].label)
        _taken(lists, select_same_label(labels))
    left, right = lists.free(None, True)

    def across(i):
        for j in right:
            if lists.one_layer_lost(i, j):
                c, o, e = lists.contained(i, j), old[i].ordinal is not None and old[i].ordinal == new[j].ordinal, lists.edge(i, j)
                if _across_rank(lists.bound(i, j), c, o, e) is not None:
                    s = lists.score(i, j)
                    if (rank := _across_rank(s, c, o, e)) is not None:
                        yield rank, j, s

    _taken(lists, _best_first(left, across, _across_worth))
    left, right = lists.free(None, False)
    for i in left:
        cols = [j for j in right if j not in lists.taken]
        if len(cols) == 1 and not scored:
            if lists.reaches(i, cols[0], 0.20):
                lists.take(i, cols[0], 0.50)
        elif cols:
            j = max(cols, key=lambda j: (lists.score(i, j), -j))
            if lists.score(i, j) >= 0.20:
                lists.take(i, j, max(lists.score(i, j), 0.50))
    left, right = lists.free()

    def rest(i):
        for j in right:
            heads = lists.heads[0][i], lists.heads[1][j]
            if all(heads) and heads[0] != heads[1]:
                continue
            near = lists.under_matched(i, j)
            held, least = not near and lists.contained(i, j) >= 0.88, 0.68 if near else 0.82
            if held or (lists.bound(i, j) >= least and lists.score(i, j) >= least):
                yield lists.rank(i, j), j, lists.score(i, j)

    _taken(lists, _best_first(left, rest, _move_worth))
    return sorted((i, j, s) for i, (j, s) in lists.found.items())


def _taken(lists: Lists, pairs: list[Pair]) -> None:
    for i, j, s in pairs:
        lists.take(i, j, s)


def _items(rows) -> list[Item]:
    get = lambda r, n: r[n] if isinstance(r, dict) else getattr(r, n)
    whole = lambda x, default: default if x is None or x != x else int(x)
    return [Item(get(r, "label") or "", get(r, "family") or "body", whole(get(r, "ordinal"), None), whole(get(r, "level"), 0), whole(get(r, "parent"), -1), get(r, "core") or "") for r in rows]


match_parts_col = vectorized(lambda a, b: match_parts(_items(a), _items(b)), "array<struct<old_ix:int,new_ix:int,score:double>>")


def match_part_lists(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("comparison_id",)) -> DataFrame:
    """(keys, old_ix, new_ix, score, limited) of part_levels() tables of two sides
    with common keys (one pair of bodies a key); limited: false, since no length of a body
    changes how it is matched."""
    k = list(keys)
    fields = ("part_ix", "label", "family", "ordinal", "level", "parent", "core")
    side = lambda df, name: df.groupBy(*k).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
    both = spread(side(old, "o").join(side(new, "n"), k), *k)
    made = both.select(*k, F.lit(False).alias("limited"), "o", "n", F.explode(match_parts_col("o", "n")).alias("m"))
    at = lambda c, i: F.get(F.col(f"{c}.part_ix"), i)
    return made.select(*k, at("o", F.col("m.old_ix")).alias("old_ix"), at("n", F.col("m.new_ix")).alias("new_ix"), "m.score", "limited")
