"""Text functions and similarity scores against plain definitions."""

from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import similarity as sim
from textloom.functions import text as tx
from textloom.operators.diff import lcs_pairs, limited_hunks, line_hunks, merged_spans, project, review_events, segments, whitespace_events

WORDS = st.text(alphabet="ab cA.\n가나①😀", max_size=25)


def plain_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@given(WORDS, WORDS)
@settings(max_examples=200, deadline=None)
def test_lcs_and_indel(a, b):
    x, y = sim._units(a), sim._units(b)
    assert sim.lcs_length(x, y) == plain_lcs(x, y) == len(lcs_pairs(x, y))
    assert all(x[i] == y[j] for i, j in lcs_pairs(x, y))
    assert sim.sequence_ratio(a, b) == SequenceMatcher(None, x, y, autojunk=False).ratio()


@given(st.lists(st.sampled_from(["a\n", "b\n", "c\r\n", "d"]), max_size=12), st.lists(st.sampled_from(["a\n", "b\n", "c\r\n", "d"]), max_size=12))
@settings(max_examples=200, deadline=None)
def test_line_hunks_rebuild(a, b):
    import re

    before, after = "".join(a), "".join(b)
    x, y = (re.findall(r"[^\n]*\n|[^\n]+", s) for s in (before, after))
    out, at = [], 0
    for _, p, q, r, s in line_hunks(before, after):
        out += x[at:p] + y[r:s]
        at = q
    assert "".join(out + x[at:]) == after


def plain_hunks(x, y):
    """The tie rule by direct definition: keep equal lines, else drop an old line
    if what is left of it fits no worse, else take a new one."""
    pre = 0
    while pre < min(len(x), len(y)) and x[pre] == y[pre]:
        pre += 1
    suf = 0
    while suf < min(len(x), len(y)) - pre and x[-1 - suf] == y[-1 - suf]:
        suf += 1
    a, b = x[pre : len(x) - suf], y[pre : len(y) - suf]
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            i, j = i + 1, j + 1
            continue
        p, r = i, j
        while (i < len(a) or j < len(b)) and not (i < len(a) and j < len(b) and a[i] == b[j]):
            if i < len(a) and (j == len(b) or plain_lcs(a[i + 1 :], b[j:]) >= plain_lcs(a[i:], b[j + 1 :])):
                i += 1
            else:
                j += 1
        out.append(("replace" if i > p and j > r else "delete" if i > p else "insert", p + pre, i + pre, r + pre, j + pre))
    return out


@given(st.lists(st.sampled_from(["a\n", "b\n", "c\n"]), max_size=9), st.lists(st.sampled_from(["a\n", "b\n", "c\n"]), max_size=9))
@settings(max_examples=400, deadline=None)
def test_line_hunks_of_repeated_lines(a, b):
    assert line_hunks("".join(a), "".join(b)) == plain_hunks(a, b)


def test_line_hunks_over_the_cell_limit():
    assert line_hunks("a\nb\nc\n", "x\ny\nz\n", cells=4) == [("replace", 0, 3, 0, 3)]
    assert line_hunks("", "x\n") == [("insert", 0, 0, 0, 1)]
    assert limited_hunks("a\nb\nc\n", "x\ny\nz\n", cells=4) == [("replace", 0, 3, 0, 3, True)] and limited_hunks("a\n", "b\n") == [("replace", 0, 1, 0, 1, False)]


@given(WORDS, WORDS)
@settings(max_examples=200, deadline=None)
def test_review_events_are_places(a, b):
    for kind, p, q, r, s, old, new in review_events(a, b):
        ua, ub = a.encode("utf-16-le"), b.encode("utf-16-le")
        assert ua[2 * p : 2 * q].decode("utf-16-le") == old and ub[2 * r : 2 * s].decode("utf-16-le") == new
        assert kind in ("change", "insert", "delete", "space")


def test_events_of_known_edits():
    assert [e[0] for e in review_events("one two three", "one 2 three")] == ["change"]
    assert [(e[0], e[5]) for e in review_events("one two three", "one three")] == [("delete", "two ")]
    assert whitespace_events("a b  c", "a b c") == [(2, 6, 2, 5)]
    assert whitespace_events("a", "b") is None
    assert project("alpha beta gamma", "alpha new beta gamma", 11) == 15


def test_keys_and_numbers():
    assert tx.match_key("  Ａ①​  b ") == "a1 b"
    assert tx.visible_key("A​ b") == "A b"
    assert tx.lineage_key("Article 3. The  Fee (10%)") == "thefee10%"
    assert [tx.roman_value(x) for x in ("iv", "XIV", "iiii", "")] == [4, 14, None, None]
    assert tx.section_number("12-3") == pytest.approx(12.003)
    assert [tx.label_ordinal(x) for x in ("③", "(2)", "b.", "(iv)", "다.", "-", "²", "٣")] == [3, 2, 2, 4, 3, None, None, 3]
    assert tx.number_text(28, "lowerLetter") == "bb" and tx.number_text(9, "upperRoman") == "IX"
    assert tx.byte_to_utf16("a😀b", 5) == 3 and tx.byte_to_utf16("a😀b", 3) is None
    assert tx.utf16_to_byte("a😀b", 3) == 5 and tx.utf16_to_byte("a😀b", 2) is None
    assert [s for _, _, s in tx.sentences("One. Two? Three")] == ["One.", "Two?", "Three"]


def test_spans_and_segments():
    assert merged_spans([(5, 7), (1, 2), (2, 4)]) == [(1, 4), (5, 7)]
    assert segments("abcd", [(0, 2)], [(1, 3)]) == [("delete", "a"), ("both", "b"), ("insert", "c"), ("normal", "d")]


def test_columns(spark):
    df = spark.createDataFrame([("a/b.rs", "x\r\ny"), ("../b.txt", ""), ("bin/x.cs", None), ("/abs", "z")], "path string, t string")
    got = df.select(tx.safe_relative_path(F.col("path")).alias("safe"), tx.supported_file(F.col("path")).alias("ok"), tx.normalize_newlines(F.col("t")).alias("n"), tx.utf16_length(F.col("t")).alias("u")).collect()
    assert [r.safe for r in got] == [True, False, False, False] and [r.ok for r in got] == [True, True, True, False]
    assert got[0].n == "x\ny" and got[0].u == 4 and got[2].n is None
    fam = spark.createDataFrame([(x,) for x in ("①", "(3)", "(b)", "(ii)", "4.", "c)", "가.", "•", "")], "l string").select(tx.label_family(F.col("l"))).collect()
    assert [r[0] for r in fam] == ["circled", "paren_number", "paren_alpha", "paren_roman", "number", "alpha", "hangul", "other", "body"]
    s = spark.createDataFrame([(["a", "b"], ["b", "c"])], "a array<string>, b array<string>").select(sim.jaccard(F.col("a"), F.col("b")), sim.containment(F.col("a"), F.col("b"))).first()
    assert s[0] == pytest.approx(1 / 3) and s[1] == 0.5
