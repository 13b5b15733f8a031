"""Nearest free paragraphs and replacements, against the stated rules by brute force."""

import random

import pytest

from textloom.operators import diff
from textloom.sources.docx import formatting_changes, nearest_equal, nearest_free, run_changes


def plain_nearest(old, new):
    """old, new: lists of texts; (old index, new index) by the rule, one new text after another."""
    used, out = set(), []
    for n, t in enumerate(new):
        free = [i for i, o in enumerate(old) if o == t and i not in used]
        if free:
            i = min(free, key=lambda i: (abs(i - n), i))
            used.add(i)
            out.append((i, n))
    return out


def test_nearest_free_is_the_rule(spark):
    rng = random.Random(2)
    rows, want = {"x": [], "y": []}, set()
    for doc in range(60):
        old, new = ([f"t{rng.randrange(1 + doc % 6)}" for _ in range(rng.randrange(25))] for _ in range(2))
        for n, t in enumerate(sorted(set(old + new))):
            places = [[i for i, s in enumerate(side) if s == t] for side in (old, new)]
            assert nearest_free(*places) == [p for p in plain_nearest(old, new) if new[p[1]] == t]
        rows["x"] += [(doc, t, 10 * i) for i, t in enumerate(old)]
        rows["y"] += [(doc, t, 7 * i) for i, t in enumerate(new)]
        want |= {(doc, 10 * i, 7 * j) for i, j in plain_nearest(old, new)}
    x, y = (spark.createDataFrame(rows[c], "doc_id int, text string, ordinal int") for c in "xy")
    got = [tuple(r) for r in nearest_equal(x, y, ("doc_id",), "text", "ordinal").collect()]
    assert len(got) == len(want) and set(got) == want
    assert nearest_free([], [1]) == [] and nearest_free([3], []) == [] and nearest_free([1, 3], [2, 2, 2]) == [(1, 2), (3, 2)]
    many = list(range(50_000))
    assert nearest_free(many, many) == list(zip(many, many)) and len(nearest_free(many, [0] * 50_000)) == 50_000


STYLE = "array<struct<ordinal:int,text:string,style:string,bold:boolean,italic:boolean,underline:boolean,strike:boolean,half_points:string,colour:string,font:string,left:string,hanging:string>>"


def test_inserted_copy_shifts_no_formatting(spark):
    para = lambda i, text, bold: (i, text, None, bold, False, False, False, "20", None, None, None, None)
    old = [para(0, "a", False), para(1, "same", True), para(2, "", False), para(3, "b", False), para(4, "same", False)]
    new = [para(0, "same", False), para(1, "a", False), para(2, "same", True), para(3, "b", False), para(4, "same", True)]
    frames = [spark.createDataFrame([(1, s), (2, s)], f"doc_id int, styles {STYLE}") for s in (old, new)]
    got = sorted((r.doc_id, r.text, r.ordinal, '"bold":true' in r.new) for r in formatting_changes(*frames).collect())
    # The new copy ahead takes the first old one (one place off), so the others meet what is left.
    places = dict((n, o) for o, n in plain_nearest(["a", "same", "b", "same"], ["same", "a", "same", "b", "same"]))
    before, after = [False, True, False, False], [False, False, True, False, True]
    want = sorted((d, "same", n, after[n]) for d in (1, 2) for n, o in places.items() if before[o] != after[n])
    assert got == want and want


def test_runs_meet_inside_their_paragraph(spark):
    run = lambda p, i, text, bold: (p, i, text, None, bold, False, False, False, "20", None, None, None, None)
    kind = STYLE.replace("ordinal:int", "paragraph:int,ordinal:int")
    old = [run(0, 0, "x", True), run(1, 0, "x", False), run(1, 1, "y", False), run(1, 2, "x", False)]
    new = [run(0, 0, "new", False), run(1, 0, "x", True), run(2, 0, "x", False), run(2, 1, "y", True), run(2, 2, "x", True)]
    frames = [spark.createDataFrame([(1, s)], f"doc_id int, runs {kind}") for s in (old, new)]
    assert sorted((r.text, r.paragraph, '"bold":true' in r.new) for r in run_changes(*frames).collect()) == [("x", 2, True), ("y", 2, True)]


def plain_pairs(markers):
    """Pairs of one part by the stated rule, all deletions against all insertions."""
    def far(at, start, end):
        return 0 if start <= at <= end else min(abs(at - start), abs(at - end))

    found = []
    for d in markers:
        for a in markers:
            if d["kind"] != "delete" or a["kind"] != "insert" or d["visible"] == a["visible"] or d["old_end"] <= d["old_start"] or a["new_end"] <= a["new_start"]:
                continue
            old, new = far(a["old_start"], d["old_start"], d["old_end"]), far(d["new_start"], a["new_start"], a["new_end"])
            near = max(6, min(28, round(0.1 * (d["text_length"] + a["text_length"]))))
            same = d["item"] == a["item"]
            if (old <= near and new <= near) or (same and old <= 2 * near and new <= 2 * near):
                found.append((old + new - 4 * same, d["ix"], a["ix"]))
    used_d, used_a, out = set(), set(), set()
    for _, d, a in sorted(found):
        if d in used_d:
            continue
        used_d.add(d)
        if a not in used_a:
            used_a.add(a)
            out.add((d, a))
    return out


COLUMNS = ("pair_id", "part", "ix", "kind", "visible", "old_start", "old_end", "new_start", "new_end", "text_length", "item")
SCHEMA = "pair_id int, part string, ix int, kind string, visible string, old_start int, old_end int, new_start int, new_end int, text_length int, item int"


def test_replacements_are_the_rule(spark):
    rng = random.Random(4)
    rows, want = [], set()
    for pair in range(80):
        for part in ("body", "title", None):
            mine = []
            for ix in range(rng.randrange(14)):
                at, n = rng.randrange(160), rng.randrange(0, 30)
                to = max(0, at + rng.randrange(-30, 30))
                kind = rng.choice(["delete", "insert", "change"])
                span = {"delete": (at, at + n, to, to), "insert": (at, at, to, to + n), "change": (at, at + n, to, to + n)}[kind]
                mine.append(dict(zip(COLUMNS, (pair, part, ix, kind, rng.choice(["p", "q", "r"]), *span, rng.randrange(400), rng.choice([None, 1, 2])))))
            rows += [tuple(m.values()) for m in mine]
            want |= {(pair, part, d, a) for d, a in plain_pairs(mine)}
    rows += rows[:20]
    got = [tuple(r) for r in diff.replacement_pairs(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(want) and set(got) == want and len(want) > 100
    assert diff.replacement_pairs(spark.createDataFrame([], SCHEMA)).count() == 0
    odd = [(1, "body", 0, "delete", None, 0, 3, 0, 0, 9, 1), (None, "body", 1, "delete", "a", 0, 3, 0, 0, 9, 1), (None, "body", 2, "insert", "b", 1, 1, 0, 4, 9, 1)]
    assert [tuple(r) for r in diff.replacement_pairs(spark.createDataFrame(odd, SCHEMA)).collect()] == [(None, "body", 1, 2)]


def test_distant_events_are_assigned_by_score():
    d, a, b = ("delete", 10, 14, 10, 10, "gone", ""), ("insert", 30, 30, 26, 29, "", "far"), ("insert", 16, 16, 12, 15, "", "new")
    assert diff.coalesce_events([d, a, b], 100) == [("change", 10, 16, 10, 15, "gone", "new"), a]
    assert diff.coalesce_events([d, a], 100) == [("change", 10, 30, 10, 29, "gone", "far")] and diff.coalesce_events([d, ("insert", 60, 60, 56, 57, "", "x")], 100)[0] == d


def test_grid_shares_rows(spark):
    """One row for a base unit with its matches, and for like additions of several versions at one place."""
    from textloom.operators import align

    unit = lambda doc, ix, title, body: ("c", doc, ix, "article", "", title, body)
    units = [unit(1, 0, "Fees", "The fee is ten euros a month."), unit(1, 1, "Notice", "Notice is given in writing to the other party."), unit(1, 2, "Term", "The term is one year."), unit(2, 0, "Notice", "Notice is given in writing to the other party."), unit(2, 1, "Fees", "The fee is ten euros a month."), unit(2, 2, "Notice", "Notice is given in writing to the other party."), unit(2, 3, "Law", "Courts decide.")]
    u = spark.createDataFrame(units, "comparison_id string, doc int, unit_ix int, kind string, number string, title string, body string")
    bases = spark.createDataFrame([("c", 0), ("c", 1)], "comparison_id string, unit_ix int")
    matches = spark.createDataFrame([("c", 1, 0, 0), ("c", 2, 0, 1), ("c", 1, 1, 2)], "comparison_id string, doc int, base_ix int, other_ix int")
    got = {(r.row_id, r.base_ix, r.doc, r.other_ix) for r in align.grid(bases, matches, u.select("comparison_id", "doc", "unit_ix"), units=u).collect()}
    # The notices behind the fees share a row, the one ahead of them does not.
    rows = {}
    for row, base, doc, ix in got:
        rows.setdefault(row, set()).add((base, doc, ix))
    assert [rows[i] for i in sorted(rows)] == [{(None, 2, 0)}, {(0, 1, 0), (0, 2, 1)}, {(None, 1, 1), (None, 2, 2)}, {(None, 2, 3)}, {(1, 1, 2)}] and sorted(rows) == [1, 2, 3, 4, 5]


if __name__ == "__main__":
    pytest.main([__file__])


def test_texts_without_articles_are_cut_once(monkeypatch):
    """Matching by words cuts each text into words once, and makes no keys of titles and bodies."""
    import pandas as pd

    from textloom.operators import align

    cut, lexer = [], align.similarity_words
    monkeypatch.setattr(align, "similarity_words", lambda x: (cut.append(x), lexer(x))[1])
    monkeypatch.setattr(align, "lineage_key", lambda x: 1 / 0)
    frame = lambda bodies: pd.DataFrame({"kind": "block", "title": "", "number": "", "body": bodies})
    old, new = ["one two three four", "five six seven eight", "nine ten"], ["five six seven nine", "one two three four", "nine ten eleven"]
    assert [(i, j) for i, j, *_ in align.align_units(frame(old), frame(new))] == [(0, 1), (1, 0), (2, 2)]
    assert sorted(cut) == sorted(old + new)
