"""Readers, sinks, commits, streams, and the registered queries."""

import io
import subprocess
import zipfile

import pytest

from textloom.sinks import office
from textloom.sources import decode, docx, git

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def package(body, numbering="", styles=""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        if numbering:
            z.writestr("word/numbering.xml", f"<w:numbering {W}>{numbering}</w:numbering>")
        if styles:
            z.writestr("word/styles.xml", f"<w:styles {W}>{styles}</w:styles>")
    return out.getvalue()


def p(text, props=""):
    return f"<w:p><w:pPr>{props}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"


def test_decode():
    t = "한글 text, 가나다라 마바사"
    for raw in (t.encode(), t.encode("utf-8-sig"), t.encode("utf-16"), t.encode("cp949"), "plain text here".encode("utf-16-le")):
        assert decode.decode(raw) in (t, "plain text here")
    assert "�" in decode.decode(b"\xff\x80\xfe\x81\x01") and decode.decode(b"") == ""


def test_docx_blocks():
    num = '<w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%1."/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num>'
    ref = '<w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr>'
    nested = f"<w:tbl><w:tr><w:tc>{p('in')}</w:tc></w:tr></w:tbl>"
    table = f'<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr>{p("a")}{nested}</w:tc><w:tc>{p("b")}</w:tc></w:tr></w:tbl>'
    hidden = "<w:p><w:r><w:rPr><w:vanish/></w:rPr><w:t>no</w:t></w:r><w:del><w:r><w:delText>no</w:delText></w:r></w:del><w:ins><w:r><w:t>yes</w:t></w:r></w:ins></w:p>"
    raw = package(p("one", ref) + f"<w:sdt><w:sdtContent>{p('two', ref)}</w:sdtContent></w:sdt>" + table + hidden, num)
    got = docx.blocks(raw)
    assert [b[0] for b in got] == ["1. one", "2. two", "a", "in", "b", "yes"]
    assert got[2][1:5] == (0, 0, 0, 2) and got[3][6:9] == (0, 0, 0) and got[4][3] == 2
    assert docx.flat_text(raw).splitlines()[0] == "1. one"


def test_text_boxes_once():
    mc = "http://schemas.openxmlformats.org/markup-compatibility/2006"
    box = lambda t: f"<w:pict><w:txbxContent>{p(t)}</w:txbxContent></w:pict>"
    both = f'<m:AlternateContent xmlns:m="{mc}"><m:Choice>{box("one")}</m:Choice><m:Fallback>{box("one")}</m:Fallback></m:AlternateContent>'
    raw = package(f"<w:p><w:r><w:t>main</w:t></w:r><w:r>{both}</w:r><w:r>{box('two')}</w:r></w:p>")
    assert [b[0] for b in docx.blocks(raw)] == ["main", "one", "two"]


def full_package(body, header="head", link="http://a.test/", extra=""):
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document {W} xmlns:r="{rel}"><w:body>{body}<w:sectPr><w:headerReference r:id="h"/></w:sectPr></w:body></w:document>')
        z.writestr("word/_rels/document.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="h" Type="{rel}/header" Target="header1.xml"/><Relationship Id="l" Type="{rel}/hyperlink" Target="{link}" TargetMode="External"/></Relationships>')
        z.writestr("word/header1.xml", f'<w:hdr {W}><w:p w:rsidR="{extra}"><w:r><w:t>{header}</w:t></w:r></w:p></w:hdr>')
    return out.getvalue()


def test_package_guards(spark):
    from textloom.sources import package as pk

    field = '<w:p><w:r><w:instrText>PAGE</w:instrText></w:r></w:p><w:p><w:hyperlink r:id="l"><w:r><w:t>x</w:t></w:r></w:hyperlink></w:p>'
    plain, linked = full_package(p("a")), full_package(p("a") + field)
    assert [x[:4] for x in pk.special_content(linked)] == [(0, "field", "PAGE", ""), (1, "link", "hyperlink>http://a.test/", "x")]
    assert pk.ancillary(plain) == pk.ancillary(full_package(p("b"), extra="00AB")) != pk.ancillary(full_package(p("a"), header="other"))
    table = '<w:tbl><w:tblGrid><w:gridCol w:w="100"/><w:gridCol w:w="50"/></w:tblGrid><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/><w:shd w:fill="ffee00"/></w:tcPr><w:p/></w:tc></w:tr></w:tbl>'
    assert pk.table_geometry(full_package(table)) == [(0, 0, 0, 2, 150, [100, 50], "FFEE00")]
    tracked = full_package("<w:p><w:ins><w:r><w:t>x</w:t></w:r></w:ins></w:p>")
    cases = [(plain, full_package(p("b")), []), (plain, tracked, ["revisions"]), (linked, None, ["formats"]), (plain, None, []), (linked, plain, ["special content"]), (linked, full_package(p("a") + field, link="http://b.test/"), ["special content"]), (plain, full_package(p("a"), header="other"), ["ancillary parts"]), (None, None, [])]
    df = spark.createDataFrame([(i, bytearray(a) if a else None, bytearray(b) if b else None) for i, (a, b, _) in enumerate(cases)], "i int, old binary, new binary")
    assert [r.refusals for r in pk.export_refusals(df).orderBy("i").collect()] == [c[2] for c in cases]
    side = lambda raw: spark.createDataFrame([(1, bytearray(raw))], "doc_id int, content binary")
    assert [tuple(r) for r in pk.ancillary_changes(side(plain), side(full_package(p("a"), header="other"))).collect()] == [(1, "header", 0, "modified")]


def test_tracked_document_accepts_and_rejects():
    old, new = "one line\nsecond line here\ngone", "one line\nsecond row here\nadded at end"
    raw = office.tracked_document(old, new)
    assert docx.flat_text(raw).splitlines() == ["one line", "second row here", "added at end"] and office.has_revisions(raw)
    assert raw == office.tracked_document(old, new)


def test_spreadsheets():
    for raw, n in ((office.pair_sheet("a\nb & <c>", "a\nb & <d>"), 3), (office.three_way_sheet("a\nb", "a\nx", "a\nx\ny"), 5)):
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            sheet = z.read("xl/worksheets/sheet1.xml").decode()
        assert sheet.count("<row ") == n and "\x00" not in sheet
    assert office.column_name(0) == "A" and office.column_name(27) == "AB"
    assert office.xml("a\x01<") == "a&lt;"


def test_write_and_read_files(spark, tmp_path):
    pairs = spark.createDataFrame([(1, "a", "b"), (2, None, "c")], "pair_id int, old string, new string")
    out = office.write_files(pairs, str(tmp_path), office.tracked_document, ".docx").collect()
    assert len(out) == 2
    assert docx.read_docx(spark, str(tmp_path)).count() >= 2
    (tmp_path / "t" / "bin").mkdir(parents=True)
    (tmp_path / "t" / "x.txt").write_bytes("한글".encode("cp949"))
    (tmp_path / "t" / "bin" / "y.txt").write_text("no")
    assert [r.path for r in decode.read_snapshot(spark, str(tmp_path / "t")).collect()] == ["x.txt"]
    assert {r.text for r in decode.read_texts(spark, str(tmp_path / "t")).collect()} == {"한글", "no"}


def test_files_are_never_lost(spark, tmp_path, monkeypatch):
    """Names differ where keys do, files that exist stay, files that are too large are told."""
    pairs = spark.createDataFrame([("a b", "x", "y"), ("a/b", "x", "z"), ("ä", "x", "y")], "pair_id string, old string, new string")
    out = [office.write_files(pairs, str(tmp_path), key="pair_id").collect() for _ in range(2)]
    assert len({r.path for r in out[0]}) == 3 and sorted(out[0]) == sorted(out[1])
    with pytest.raises(Exception, match="exists already"):
        office.write_files(pairs.replace("y", "other"), str(tmp_path), key="pair_id").collect()
    assert not [p for p in tmp_path.iterdir() if p.name.startswith(".")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("text")
    (tmp_path / "in" / "b.md").write_text("other")
    (tmp_path / "in" / "c.docx").write_bytes(package(p("para")))
    (tmp_path / "in" / "d.rs").write_bytes(b"fn a() {}")
    (tmp_path / "in" / "e.rs").write_bytes(b"\xff")
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.state) for r in decode.read_documents(spark, str(tmp_path / "in")).collect()}
    assert got["a.txt"] == ("text", "ok") and got["c.docx"] == ("para", "ok") and got["b.md"] == (None, "unsupported")
    assert {r.path.rsplit("/", 1)[1]: (r.content, r.state) for r in decode.read_code(spark, str(tmp_path / "in")).collect()} == {"d.rs": ("fn a() {}", "ok"), "e.rs": (None, "invalid")}
    files = decode._files(spark, str(tmp_path / "in")).where("path LIKE '%.txt'")
    assert [(r.text, r.state) for r in decode._told(files, decode.decode_col, most=3).collect()] == [(None, "too large")]
    root = str(tmp_path / "in")
    (tmp_path / "in" / "link").symlink_to(tmp_path)
    (tmp_path / "in" / "link.txt").symlink_to(tmp_path / "in" / "a.txt")
    assert sorted(r.path for r in decode.read_snapshot(spark, root).collect()) == ["a.txt", "b.md", "c.docx", "d.rs", "e.rs"]
    for limits in ({"most_files": 2}, {"most_bytes": 3}):
        with pytest.raises(ValueError):
            decode.read_snapshot(spark, root, **limits)


def test_plausible_byte_orders():
    text = "계약서 본문 日本語の文章"
    assert decode.utf16_by_plausibility(text.encode("utf-16-le")) == text == decode.utf16_by_plausibility(text.encode("utf-16-be"))
    assert decode.utf16_by_plausibility(b"abc") is None and decode.plausibility("") == float("-inf")
    assert decode.plausibility("a") == 3.5 and decode.plausibility("가") == 6.0 and decode.plausibility("a\x00") == (3.5 - 12) / 2 and decode.plausibility("a" * 9000 + "\x00" * 9000) < 0


def test_git_output_is_bounded(tmp_path):
    subprocess.run(["git", "-C", str(tmp_path), "init", "-q"], check=True)
    with pytest.raises(ValueError, match="more than 3 bytes"):
        git.git(str(tmp_path), "rev-parse", "--git-dir", most=3)
    with pytest.raises(ValueError, match="failed|fatal|ambiguous|unknown"):
        git.git(str(tmp_path), "rev-parse", "--verify", "HEAD")
    with pytest.raises(ValueError):
        git.fields(b"open")


def test_spreadsheet_formats():
    raw = office.spreadsheet(["A", "B"], [[[("insert", "x")], [("normal", "m")]], [[("both", "Part")], []]], [10, 10], kinds=["text", "section"])
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        sheet, styles = (z.read(f"xl/{n}.xml").decode() for n in ("worksheets/sheet1", "styles"))
    assert '<color rgb="FF14746F"/><u/>' in sheet and '<strike/><color rgb="FF6A4C93"/><u/>' in sheet
    assert 'r="A1" t="inlineStr" s="2"' in sheet and 'r="A2" t="inlineStr" s="1"' in sheet and 'r="B2" t="inlineStr" s="5"' in sheet and 'r="A3" t="inlineStr" s="3"' in sheet
    assert styles.count("<xf ") == 5 and 'ht="24"' in sheet and 'ht="21"' in sheet
    assert office.row_height(["a" * 25, ""], [10, 10]) == 51 and office.row_height(["é" * 10], [10]) == 36
    assert office.positional_lines("a\nb\nc", "a\nx\ny\nc") == [("a", "a"), ("b", "x"), (None, "y"), ("c", "c")]


def test_number_levels_of_an_instance():
    level = lambda fmt, text: f'<w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="{fmt}"/><w:lvlText w:val="{text}"/></w:lvl>'
    num = f'<w:abstractNum w:abstractNumId="0">{level("decimal", "%1.")}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/><w:lvlOverride w:ilvl="0">{level("upperRoman", "(%1)")}</w:lvlOverride></w:num>'
    ref = '<w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr>'
    assert [b[0] for b in docx.blocks(package(p("a", ref) + p("b", ref), num))] == ["(I) a", "(II) b"]


def test_registered_functions(spark, tmp_path):
    from textloom.functions.register import FUNCTIONS, register

    names = register(spark)
    assert set(FUNCTIONS) < set(names)
    r = spark.sql("SELECT match_key('Ａ b') AS k, indel_ratio('ab', 'ac') AS r, line_hunks('a\nb', 'a\nc')[0].kind AS h, size(declarations('fn a() {}', 'rust')) AS d").first()
    assert (r.k, r.r, r.h, r.d) == ("a b", 0.5, "replace", 1)
    assert [tuple(r) for r in spark.sql("SELECT ord, kind FROM line_hunk_rows('a\nb', 'b\nc')").collect()] == [(1, "delete"), (2, "insert")] or spark.sql("SELECT * FROM line_hunk_rows('a', 'b')").count() == 1
    assert spark.sql("SELECT kind FROM document_unit_rows('Article 1 (A)\nx\nArticle 2 (B)\ny')").count() == 2
    (tmp_path / "a.docx").write_bytes(package(p("one") + p("two")))
    assert [(r.block_ix, r.text) for r in spark.read.format("docx").load(str(tmp_path)).orderBy("block_ix").collect()] == [(0, "one"), (1, "two")]


def test_stream_without_repeats(spark, tmp_path):
    from textloom.streaming.versions import distinct_versions

    rows = [("f", "1", "2024-01-01 00:00:00"), ("f", "1", "2024-01-01 00:01:00"), ("f", "2", "2024-01-01 00:02:00")]
    spark.createDataFrame(rows, "path string, sha string, t string").selectExpr("path", "sha", "CAST(t AS timestamp) AS added_at").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("path string, sha string, added_at timestamp").parquet(str(tmp_path / "in"))
    q = distinct_versions(s).writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.sha for r in spark.table("once").collect()) == ["1", "2"]


def test_project_round_trip(spark, tmp_path):
    decode.write_project("p", [{"label": "v1", "path": "a.txt", "sha256": "x", "addedAt": "2024-01-01T00:00:00Z"}], str(tmp_path / "p.json"))
    assert decode.read_project(spark, str(tmp_path / "p.json")).first().label == "v1"


def test_git(spark, tmp_path):
    from textloom.operators.ledger import file_ledger

    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.txt").write_text("same text")
    run("add", "."), run("commit", "-qm", "1"), run("mv", "a.txt", "b.txt"), run("commit", "-qm", "2")
    led = file_ledger(git.read_tree(spark, str(tmp_path), "HEAD~1"), git.read_tree(spark, str(tmp_path), "HEAD"), whole_tree=True)
    assert [(r.kind, r.before_path, r.after_path) for r in led.collect()] == [("renamed", "a.txt", "b.txt")]
    assert len(git.first_parents(str(tmp_path), "HEAD~1", "HEAD")) == 2
    with pytest.raises(ValueError):
        git.resolve(str(tmp_path), "--all")


def test_symbol_history(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init", "-q")
    for i, text in enumerate(("fn one() { let a = 1; }\n", "fn one() { let a = 2; }\n", "fn two() { let a = 2; }\n")):
        (tmp_path / "a.rs").write_text(text)
        run("add", "."), run("commit", "-qm", str(i))
    changes, skipped = git.symbol_history(spark, str(tmp_path), "HEAD~2", "HEAD")
    assert [(r.step, r.path, r.change, r.before_name, r.after_name) for r in changes.orderBy("step").collect()][0] == (0, "a.rs", "modify", "one", "one")
    assert {r.step for r in changes.collect()} == {0, 1} and skipped.count() == 0
    events = [(r.step, r.kind, r.location) for r in git.commit_events(spark, str(tmp_path), "HEAD~2", "HEAD").orderBy("step", "location").collect()]
    assert events == [(0, "modified", "file"), (0, "modify", "function one"), (1, "modified", "file"), (1, "rename", "function one -> two")]
    none, skipped = git.symbol_history(spark, str(tmp_path), "HEAD", "HEAD")
    assert none.count() == skipped.count() == 0


def test_stream(spark, tmp_path):
    from textloom.streaming.versions import hunks_between_versions

    for i, t in enumerate(("a\n", "a\nb\n")):
        spark.createDataFrame([("f", i, t)], "path string, version long, content string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("path string, version long, content string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = hunks_between_versions(s).writeStream.format("memory").queryName("hunks").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.path, r.version, r.kind) for r in spark.table("hunks").collect()] == [("f", 1, "insert")]


DATA = "/root/testdata/sf0.001"


def test_queries_against_sql(spark):
    import duckdb

    from textloom.plans import registry

    cx = duckdb.connect()
    for t in "documents pages benchmark conversations lineitem orders part".split():
        cx.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    tidy = lambda rs: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rs), key=str)
    for name, query in registry.QUERIES.items():
        df = query(spark, DATA)
        cols = sorted(df.columns)
        got = tidy(df.select(*cols).collect())
        if name in registry.ORACLE_SQL:
            assert got == tidy(cx.sql(registry.ORACLE_SQL[name]).select(*cols).fetchall()), name
