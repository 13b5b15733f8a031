"""Matching blocks, and comparisons that are scored no more than they need."""

import random
from difflib import SequenceMatcher

import pytest

from textloom.functions import blocks, similarity
from textloom.operators import align, compare, parts


def test_blocks_are_those_of_difflib():
    r = random.Random(7)
    for _ in range(400):
        letters = r.choice([1, 2, 5, 30])
        a = [r.randrange(letters) for _ in range(r.randrange(r.choice([5, 40, 160])))]
        b = a[r.randrange(len(a) + 1) :] + a[: r.randrange(len(a) + 1)] + [r.randrange(letters) for _ in range(r.randrange(9))]
        m = SequenceMatcher(None, a, b, autojunk=False)
        assert blocks.matching_blocks(a, b) == [tuple(x) for x in m.get_matching_blocks()] and blocks.matched_share(a, b) == m.ratio()
    assert similarity.sequence_ratio("a\U0001f600b", "a\U0001f601b") == 0.75 and similarity.sequence_ratio("", "") == 1.0


def test_long_bodies_are_matched_by_their_words(monkeypatch):
    def refused(*_):
        raise AssertionError("characters were compared")

    a = "The tenant pays the rent on the first day. " * 40
    old, new = (compare.Unit(0, "block", "", "", "", x, "") for x in (a, a + "The landlord answers."))
    expected = compare.compare_pair(old, new)
    for module in (parts, compare):
        monkeypatch.setattr(module, "part_score", refused)
    assert compare.compare_pair(old, new) == expected and [m[0] for m in expected[0]] == ["insert"]


def test_generic_pairs_share_words_or_have_none():
    assert align.generic_pairs(["---", "a b", "", "q"], ["***", "a b c", "z"]) == [(0, 0, 1.0), (1, 1, pytest.approx(0.8))]


def test_units_are_aligned_from_arrow_columns(spark):
    rows = [(7, s, i, "block", "", "", f"text {i} of side {s * (i % 2)}") for s in (0, 1) for i in range(4)]
    found = align.match_units(spark.createDataFrame(rows, "doc_id long, doc_ord int, unit_ix int, kind string, number string, title string, body string"), ("doc_id",))
    assert "MapInArrow" in found._jdf.queryExecution().toString()
    assert sorted((r.doc_id, r.old_ix, r.new_ix, r.mode) for r in found.collect()) == [(7, i, i, "same") for i in range(4)]
