"""Special content of packages: what stayed, what moved."""

import pytest

from tests_docx import W
from test_sources import full_package
from textloom.sources import special


def p(*runs):
    return "<w:p>" + "".join(r if r.startswith("<w:") else f'<w:r><w:t xml:space="preserve">{r}</w:t></w:r>' for r in runs) + "</w:p>"


FIELD = "<w:r><w:instrText>PAGE</w:instrText></w:r>"
LINK = '<w:hyperlink r:id="l"><w:r><w:t>the terms</w:t></w:r></w:hyperlink>'
DRAWING = '<w:r><w:drawing><w:blip r:embed="l"/></w:drawing></w:r>'
MARK = '<w:bookmarkStart w:name="b"/>'
TO_MARK = '<w:hyperlink w:anchor="b"><w:r><w:t>see</w:t></w:r></w:hyperlink>'
HYPHEN = "<w:r><w:softHyphen/></w:r>"


def stands(*paragraphs):
    return full_package(p("first words") + "".join(paragraphs) + p("last words"))


CASES = {
    "nothing special": (stands(p("a")), stands(p("b")), []),
    "equal": (stands(p("page ", FIELD, " of it")), stands(p("page ", FIELD, " of it"), p("new")), []),
    "edited paragraph keeps its field": (stands(p("page ", FIELD, " of it")), stands(p("page ", FIELD, " of it and more")), []),
    "field moved in an unchanged paragraph": (stands(p("page ", FIELD, " of it")), stands(p("page of ", FIELD, " it")), [("inline", "moved")]),
    "rewritten paragraph": (stands(p("page ", FIELD, " of it")), stands(p("quite other ", FIELD, " text")), [("inline", "moved")]),
    "field added": (stands(p("a")), stands(p("a", FIELD)), [("inline", "added")]),
    "field gone": (stands(p("a", FIELD)), stands(p("a")), [("inline", "deleted")]),
    "another field": (stands(p("a", FIELD)), stands(p("a", FIELD.replace("PAGE", "DATE"))), [("inline", "replaced")]),
    "link in an edited paragraph": (stands(p("read ", LINK, " now")), stands(p("please read ", LINK, " now")), []),
    "link text edited": (stands(p("read ", LINK, " now")), stands(p("read ", LINK.replace("the terms", "all terms"), " now")), []),
    "link moved to another paragraph": (stands(p("read ", LINK), p("other")), stands(p("read "), p("other", LINK)), [("relation", "moved")]),
    "drawing in its paragraph": (stands(p("see ", DRAWING)), stands(p("see ", DRAWING), p("new")), []),
    "drawing in an edited paragraph": (stands(p("see ", DRAWING)), stands(p("see it ", DRAWING)), [("relation", "moved")]),
    "equal paragraphs change places": (stands(p("same ", DRAWING), p("x"), p("same ")), stands(p("same "), p("x"), p("same ", DRAWING)), [("relation", "moved")]),
    "one more equal paragraph ahead": (stands(p("mid"), p("same ", DRAWING)), stands(p("same "), p("mid"), p("same ", DRAWING)), []),
    "bookmark under a rewritten text": (stands(p(MARK, "one"), p(TO_MARK)), stands(p(MARK, "two"), p(TO_MARK)), []),
    "bookmark that nothing names": (stands(p(MARK, "one")), stands(p("one")), []),
    "hyphen at its place": (stands(p("so", HYPHEN, "ft")), stands(p("other", HYPHEN, "words")), []),
}


def test_specials_that_stay_and_move(spark):
    rows = [(n, bytearray(a), bytearray(b), "x") for n, (a, b, _) in CASES.items()]
    rows += [("no old", None, rows[0][2], "x"), rows[4]]
    df = spark.createDataFrame(rows, "name string, old binary, new binary, kind string")
    from pyspark.sql import functions as F

    told = special.special_changes(df)
    got = df.withColumns({"a": F.sha2("old", 256), "b": F.sha2("new", 256)}).join(told.withColumnRenamed("kind", "of"), (F.col("a") == told["old"]) & (F.col("b") == told["new"])).select("name", "family", "change").distinct().collect()
    found = {}
    for r in got:
        found.setdefault(r["name"], []).append((r["family"], r["change"]))
    assert {n: sorted(found.get(n, [])) for n in CASES} == {n: want for n, (_, _, want) in CASES.items()}
    assert special.special_changes(df.limit(0)).count() == 0


def test_refusals_of_edited_paragraphs(spark):
    from textloom.sources.package import export_refusals

    names = ["edited paragraph keeps its field", "drawing in an edited paragraph", "link in an edited paragraph"]
    df = spark.createDataFrame([(n, bytearray(CASES[n][0]), bytearray(CASES[n][1])) for n in names + names[:1]], "name string, old binary, new binary")
    assert sorted((r["name"], r["refusals"]) for r in export_refusals(df).collect()) == sorted([(names[0], []), (names[0], []), (names[1], ["special content"]), (names[2], [])])


def test_places_in_a_paragraph():
    raw = full_package(p("one ", LINK, " two", FIELD, '<w:del><w:r><w:t>gone</w:t></w:r></w:del>', "<w:r><w:rPr><w:vanish/></w:rPr><w:t>hid</w:t></w:r>", " three"))
    texts, found = special.read(raw)
    assert texts == ["one the terms two three"] and W
    assert [(f[1], f[2], f[5], f[6], f[7]) for f in found] == [("relation", "hyperlink", "the terms", "one ", " two three"), ("inline", "field", "", "one the terms two", " three")]


if __name__ == "__main__":
    pytest.main([__file__])
