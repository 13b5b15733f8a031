"""Matching blocks of two sequences, as difflib.SequenceMatcher (no junk) finds them.

A longest block is found by its parts instead of by every pair of equal elements, of
which a text has a quarter of all pairs in its spaces alone: elements become characters,
a block of 2 * K - 1 or more holds one of every K-th place's K characters of the other
side, and the length of a shorter one is found by halving, from the sets of all parts of
a length. So a search takes the sum of the lengths, not their product, unless parts repeat.
"""

from __future__ import annotations

from collections.abc import Sequence

#: Lengths of the parts that long blocks are found by, longest first.
SEEDS = (32, 8)


def _strings(a: Sequence, b: Sequence) -> tuple[str, str] | None:
    """The sequences with a character for each different element; None if there are too many."""
    if isinstance(a, str) and isinstance(b, str):
        return a, b
    codes: dict = {}
    coded = [[codes.setdefault(x, len(codes)) for x in s] for s in (a, b)]
    if len(codes) > 0x110000:
        return None
    return "".join(map(chr, coded[0])), "".join(map(chr, coded[1]))


def _ahead(x: str, i: int, i1: int, y: str, j: int, j1: int) -> int:
    """How many characters from x[i] and y[j] on are equal."""
    most, n, step = min(i1 - i, j1 - j), 0, 16
    while n < most:
        step = min(step, most - n)
        if x[i + n : i + n + step] == y[j + n : j + n + step]:
            n += step
            step *= 2
        elif step == 1:
            break
        else:
            step //= 2
    return n


def _behind(x: str, i0: int, i: int, y: str, j0: int, j: int) -> int:
    """How many characters before x[i] and y[j] are equal."""
    most, n, step = min(i - i0, j - j0), 0, 16
    while n < most:
        step = min(step, most - n)
        if x[i - n - step : i - n] == y[j - n - step : j - n]:
            n += step
            step *= 2
        elif step == 1:
            break
        else:
            step //= 2
    return n


def _seeded(x: str, i0: int, i1: int, y: str, j0: int, j1: int, k: int) -> tuple[int, int, int]:
    """(-size, i, j) of the longest block that holds a k-th place's part of y, the earliest of
    equals; (0, i0, j0) if there is none."""
    where: dict[str, list[int]] = {}
    for j in range(j0, j1 - k + 1, k):
        where.setdefault(y[j : j + k], []).append(j)
    best, ends = (0, i0, j0), {}
    for i in range(i0, i1 - k + 1):
        for j in where.get(x[i : i + k], ()):
            if ends.get(i - j, -1) > i:
                continue  # in a block of this diagonal
            back, on = _behind(x, i0, i, y, j0, j), _ahead(x, i, i1, y, j, j1)
            ends[i - j] = i + on
            best = min(best, (-back - on, i - back, j - back))
    return best


def _longest(x: str, i0: int, i1: int, y: str, j0: int, j1: int) -> tuple[int, int, int]:
    """(i, j, size) of the longest block in the ranges, the earliest in x, then in y."""
    most = min(i1 - i0, j1 - j0)
    for k in SEEDS:
        if most >= 2 * k - 1:
            size, i, j = _seeded(x, i0, i1, y, j0, j1, k)
            if -size >= 2 * k - 1:
                return i, j, -size
            most = 2 * k - 2
    low, high, held = 0, most, frozenset()
    while low < high:
        n = (low + high + 1) // 2
        parts = {y[j : j + n] for j in range(j0, j1 - n + 1)}
        if parts.isdisjoint([x[i : i + n] for i in range(i0, i1 - n + 1)]):
            high = n - 1
        else:
            low, held = n, parts
    if not low:
        return i0, j0, 0
    i = next(i for i in range(i0, i1 - low + 1) if x[i : i + low] in held)
    return i, y.index(x[i : i + low], j0, j1), low


def matching_blocks(a: Sequence, b: Sequence) -> list[tuple[int, int, int]]:
    """Longest contiguous blocks, earliest first among equals, and again on both
    sides; the last one is empty and marks the ends."""
    coded = _strings(a, b)
    if coded is None:
        from difflib import SequenceMatcher

        return [tuple(m) for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()]
    x, y = coded
    todo, found = [(0, len(x), 0, len(y))], []
    while todo:
        i0, i1, j0, j1 = todo.pop()
        i, j, size = _longest(x, i0, i1, y, j0, j1)
        if size:
            found.append((i, j, size))
            if i0 < i and j0 < j:
                todo.append((i0, i, j0, j))
            if i + size < i1 and j + size < j1:
                todo.append((i + size, i1, j + size, j1))
    out: list[tuple[int, int, int]] = []
    for i, j, size in sorted(found):
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (*out[-1][:2], out[-1][2] + size)
        else:
            out.append((i, j, size))
    return [*out, (len(x), len(y), 0)]


def matched_share(a: Sequence, b: Sequence) -> float:
    """Twice the elements in matching blocks over all elements, 1 of two empty sequences."""
    total = len(a) + len(b)
    return 2 * sum(n for _, _, n in matching_blocks(a, b)) / total if total else 1.0
