"""Tracked changes in a package: accepting gives the new document, rejecting the old text."""

import io
import random
import zipfile
from xml.etree import ElementTree as ET

import pytest

from textloom.sinks import tracked
from textloom.sources import docx

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
DOC = f'xmlns:w="{W}" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" xmlns:w14="http://schemas.microsoft.com/office/word/2010/wordml" mc:Ignorable="w14"'


def package(body, styles="", settings=None, numbering=""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/></Types>')
        z.writestr("word/document.xml", f"<w:document {DOC}><w:body>{body}<w:sectPr/></w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles xmlns:w="{W}">{styles}</w:styles>')
        z.writestr("word/media/x.bin", b"\x00\x01")
        if settings is not None:
            z.writestr("word/settings.xml", f'<w:settings xmlns:w="{W}">{settings}</w:settings>')
        if numbering:
            z.writestr("word/numbering.xml", f'<w:numbering xmlns:w="{W}">{numbering}</w:numbering>')
    return out.getvalue()


def run(text, props=""):
    return f'<w:r><w:rPr>{props}</w:rPr><w:t xml:space="preserve">{text}</w:t></w:r>'


def p(*runs, props=""):
    return f"<w:p><w:pPr>{props}</w:pPr>{''.join(r if r.startswith('<') else run(r) for r in runs)}</w:p>"


def table(*rows):
    return "<w:tbl><w:tblPr/>" + "".join("<w:tr>" + "".join(f"<w:tc><w:tcPr/>{c if c.startswith('<') else p(c)}</w:tc>" for c in row) + "</w:tr>" for row in rows) + "</w:tbl>"


def texts(raw):
    return [(b[0], b[1:4]) for b in docx.blocks(raw)]


def shape(raw):
    """Body elements without empty properties, runs of one formatting joined."""
    root = ET.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml"))

    def of(e):
        tag = e.tag.split("}")[1]
        if tag == "r":
            pr = e.find(f"{{{W}}}rPr")
            return ("r", "" if pr is None else "".join(sorted(x.tag.split("}")[1] for x in pr)), "".join(x.text or "" if x.tag.endswith("}t") else f"<{x.tag.split('}')[1]}>" for x in e if not x.tag.endswith("}rPr")))
        kids = [k for k in map(of, e) if not (k[0] in ("pPr", "rPr", "trPr", "tcPr") and not k[2])]
        joined = []
        for k in kids:
            if joined and k[0] == joined[-1][0] == "r" and k[1] == joined[-1][1]:
                joined[-1] = ("r", k[1], joined[-1][2] + k[2])
            else:
                joined.append(k)
        return (tag, "".join(sorted(f"{a.split('}')[-1]}={v}" for a, v in e.attrib.items())), tuple(joined))

    return of(root.find(f"{{{W}}}body"))


def check(old, new):
    made = tracked.tracked_package(old, new)
    assert shape(tracked.resolved(made, True)) == shape(new)
    assert texts(tracked.resolved(made, False)) == texts(old)
    z = zipfile.ZipFile(io.BytesIO(made))
    ids = [e.get(f"{{{W}}}id") for e in ET.fromstring(z.read("word/document.xml")).iter() if e.tag in tracked._IDS and not e.tag.endswith("bookmarkStart")]
    assert len(ids) == len(set(ids)) and z.read("word/media/x.bin") == b"\x00\x01"
    assert b"trackRevisions" in z.read("word/settings.xml") and b"settings.xml" in z.read("[Content_Types].xml") and b"settings" in z.read("word/_rels/document.xml.rels")
    assert b"xmlns:w14=" in z.read("word/document.xml")
    return made


def test_runs_keep_their_formatting():
    bold, plain = "<w:b/>", ""
    old = package(p(run("The fee is ", plain), run("ten euros", bold), run(" a year.", plain)) + p("Second."))
    new = package(p(run("The fee is ", plain), run("twelve", "<w:i/>"), run(" euros", bold), run(" a month.", plain)) + p("Second."))
    made = check(old, new)
    root = ET.fromstring(zipfile.ZipFile(io.BytesIO(made)).read("word/document.xml"))
    gone = {d.text: d for d in root.iter(f"{{{W}}}delText")}
    assert set(gone) == {"ten", "year"}
    holder = next(r for r in root.iter(f"{{{W}}}r") if gone["ten"] in list(r))
    assert holder.find(f"{{{W}}}rPr/{{{W}}}b") is not None


def test_paragraphs_tables_rows_and_cells():
    old = package(p("Intro text here.") + p("Paragraph that goes away entirely.") + table(["name", "price"], ["tea", "3"], ["milk", "1"]) + p("End of it."))
    new = package(p("Intro text here.") + table(["name", "price"], ["tea", "4"], ["bread", "2"]) + p("A wholly new closing paragraph.") + p("End of it."))
    check(old, new)
    check(new, old)
    check(package(p("a") + table(["x", "y"], ["1", "2"])), package(p("a")))
    check(package(p("a")), package(p("a") + table(["x", "y"], ["1", "2"])))
    check(package(table(["k", "v"], ["a", "1"])), package(table(["k", "v", "w"], ["a", "1", "2"])))
    check(package(table(["k", "v", "w"], ["a", "1", "2"])), package(table(["k", "v"], ["a", "1"])))
    check(package(table(["k", p("one line") + p("two lines")])), package(table(["k", p("one line") + p("new between") + p("two lines")])))
    check(package(table(["k", table(["in", "ner"])])), package(table(["k", table(["in", "outer"])])))
    check(package(""), package(p("all new")))
    check(package(p("all old")), package(""))


def test_links_controls_and_fields_stay():
    link = lambda t: f'<w:hyperlink w:anchor="x">{run(t)}</w:hyperlink>'
    field = '<w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText>PAGE</w:instrText></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r>'
    check(package(p("see ", link("old place"), " for more", field)), package(p("see ", link("new place"), " for much more", field)))
    check(package(p("see ", link("place"), " now")), package(p("look at the ", link("place"), " right now")))
    control = lambda t: f"<w:sdt><w:sdtContent>{t}</w:sdtContent></w:sdt>"
    check(package(control(p("one two three")) + p("x")), package(control(p("one 2 three") + p("more in here")) + p("x")))
    check(package(p("a", "<w:r><w:tab/><w:t>b</w:t><w:br/></w:r>", "c")), package(p("a", "<w:r><w:tab/><w:t>bb</w:t><w:br/></w:r>", "c d")))


def test_styles_numbers_and_settings():
    style = '<w:style w:styleId="Old"><w:basedOn w:val="Base"/></w:style><w:style w:styleId="Base" w:default="1"/>'
    made = check(package(p("kept text") + p("gone text", props='<w:pStyle w:val="Old"/>'), styles=style), package(p("kept text"), settings="<w:zoom/><w:defaultTabStop/>"))
    z = zipfile.ZipFile(io.BytesIO(made))
    assert b'styleId="Old"' in z.read("word/styles.xml") and b'styleId="Base"' in z.read("word/styles.xml")
    assert [e.tag.split("}")[1] for e in ET.fromstring(z.read("word/settings.xml"))] == ["zoom", "trackRevisions", "defaultTabStop"]
    num = '<w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%1."/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num>'
    ref = '<w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr>'
    made = tracked.tracked_package(package(p("first item") + p("second item", props=ref), numbering=num), package(p("first item", props=ref) + p("second item", props=ref), numbering=num))
    root = ET.fromstring(zipfile.ZipFile(io.BytesIO(made)).read("word/document.xml"))
    assert len(list(root.iter(f"{{{W}}}ins"))) == 1 and [e.get(f"{{{W}}}original") for e in root.iter(f"{{{W}}}numberingChange")] == ["1."]
    with pytest.raises(ValueError):
        tracked.tracked_package(package(p("a")), made)


def test_random_documents():
    rng = random.Random(5)
    words = "alpha beta gamma delta the of and fee term buyer".split()
    sentence = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 9)))

    def styled(text):
        cut = rng.randint(0, len(text))
        return p(*[run(t, rng.choice(("", "<w:b/>", "<w:i/>"))) for t in (text[:cut], text[cut:]) if t])

    def edit(text):
        ws = text.split()
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(ws) + 1)
            ws[k : k + rng.randint(0, 1)] = [rng.choice(words)] * rng.randint(0, 2)
        return " ".join(ws) or "x"

    for _ in range(40):
        base = [sentence() for _ in range(rng.randint(1, 6))]
        other = [edit(t) for t in base if rng.random() < 0.8] or ["y"]
        if rng.random() < 0.5:
            other.insert(rng.randrange(len(other) + 1), sentence())
        check(package("".join(map(styled, base))), package("".join(map(styled, other))))
