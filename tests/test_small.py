"""Functions that the larger tests don't reach."""

from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import diff, ledger, review, structure


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_text_columns(spark):
    c = F.col("t")
    one = lambda col, *ts: [r[0] for r in values(spark, [(t,) for t in ts], "t string", col)]
    assert one(tx.display_line(c), "a\r\n", "a\n", "a", None) == ["a", "a", "a", None]
    assert one(tx.strip_list_label(c), " (a)  x y", "1. z", "• q", "plain 1.") == ["x y", "z", "q", "plain 1."]
    assert one(tx.mask_format_chars(c), "a​b") == ["a b"]
    assert one(tx.definition_head(c), '"Fee" means', "“Term” is", "no head") == ["Fee", "Term", ""]
    assert one(tx.low_information_title(c), "General", "x", "Payment of fees") == [True, True, False]
    assert [set(x) for x in one(tx.title_concepts(c), "The Payments of Obligations")] == [{"payment", "oblig"}] == [tx.title_concept_set("The Payments of Obligations")]
    assert one(tx.twips_to_points(F.lit(240)), "x") == [12.0] and one(tx.half_points_to_points(F.lit(21)), "x") == [10.5]
    assert one(tx.line_spacing(F.lit(360), F.lit(None).cast("string")), "x") == ["1.50x"] and one(tx.line_spacing(F.lit(300), F.lit("exact")), "x") == ["15.0 pt"]
    from textloom.functions.similarity import table_overlap

    assert values(spark, [(["a", "b", "b"], ["b", "c", "d"]), ([], [])], "a array<string>, b array<string>", F.round(table_overlap(F.col("a"), F.col("b")), 3)) == [(0.333,), (0.0,)]
    two = values(spark, [("a​ b", "a b"), ("A b", "a b")], "a string, b string", tx.semantically_equal(F.col("a"), F.col("b")))
    assert two == [(True,), (False,)]
    long = "This sentence is long enough to count here."
    assert tx.stable_sentence(f"{long} Short.", f"Other. {long}") and not tx.stable_sentence("Short. one", "Short. two")
    assert tx.stable_edge("x" * 20 + "a" * 30, "x" * 20 + "b" * 30) and not tx.stable_edge("a" * 50, "b" * 50)
    assert tx.families(["(i)", "(ii)", "", "(v)", "1.", "가."]) == ["paren_roman", "paren_roman", "body", "paren_alpha", "number", "hangul"]


def test_diff_rules(spark):
    events = [("delete", 0, 3, 0, 0, "old", ""), ("insert", 5, 5, 2, 5, "", "new"), ("insert", 90, 90, 80, 82, "", "xx")]
    assert diff.coalesce_events(events, 100) == [("change", 0, 5, 0, 5, "old", "new"), events[2]]
    assert diff.hangul_word_diff("나는 학교에 간다", "나는 학교로 간다") == [("나는", "나는"), ("학교에", "학교로"), ("간다", "간다")]
    assert diff.hangul_word_diff("가나", "다라") is None and diff.hangul_word_diff("가" * 97, "가") is None
    assert diff.whole_rewrite("short old", "other", 0.1, 1) and not diff.whole_rewrite("short old", "other", 0.9, 1)
    lines = spark.range(40).select(F.lit(1).alias("pair_id"), F.col("id").alias("line_no"))
    hunks = spark.createDataFrame([(1, 20, 21)], "pair_id int, after_start int, after_end int")
    assert sorted(r.line_no for r in diff.preview_lines(lines, hunks, first=3, around=2).collect()) == [0, 1, 2, 18, 19, 20, 21, 22, 23]
    two = values(spark, [(["a\r\n"], ["a\n"]), (["a\n"], ["b\n"]), (["a\n"], ["a\n"])], "a array<string>, b array<string>", diff.newline_only(F.col("a"), F.col("b")))
    assert two == [(True,), (False,), (False,)]
    assert diff.compact_gaps([(0, 0)], 3, 3) == [("replace", 1, 3, 1, 3)]


def test_review_tables(spark):
    m = spark.createDataFrame([("moved", "1", "2", "A", "A", "s", "s"), ("same", "1", "1", "A", "B", None, "s"), ("same", None, None, None, None, None, None)], "mode string, old_number string, new_number string, old_title string, new_title string, old_section string, new_section string")
    assert [r.statuses for r in review.classify(m).collect()] == [["moved", "renumbered"], ["retitled", "resectioned"], []]
    marks = spark.createDataFrame([("c", 1, 0, "body", 0, 0, 5), ("c", 1, 0, "header", -1, 0, 9), ("c", 1, 0, "body", 0, 0, 1)], "comparison_id string, row_id int, pair int, part string, item_order int, hunk_order int, old_start int")
    assert [(r.num, r.part, r.old_start) for r in review.numbered(marks).orderBy("num").collect()] == [(1, "header", 9), (2, "body", 1), (3, "body", 5)]
    changes = spark.createDataFrame([("c", 2, 0, 0, 0), ("c", 1, 5, 1, 1), ("c", 1, 5, 0, 2)], "comparison_id string, row_id int, position int, priority int, stable_ord int")
    assert [(r.seq, r.stable_ord) for r in review.sequenced(changes).orderBy("seq").collect()] == [(1, 2), (2, 1), (3, 0)]
    spans = spark.createDataFrame([("body", "delete", 1, 3, 0, 0, 4, None), ("header", "insert", 0, 0, 2, 4, 4, 4)], "part string, kind string, old_start int, old_end int, new_start int, new_end int, old_header int, new_header int")
    got = [(r.kind, r.doc, r.role, r.start, r.end) for r in review.placements(spans).collect()]
    assert got == [("delete", "old", "delete", 6, 8), ("delete", "new", "anchor", 1, 1), ("insert", "old", "anchor", 0, 0), ("insert", "new", "insert", 2, 4)]
    rows = spark.createDataFrame([("abcd", [(0, 2)], [(1, 3)])], "text string, deleted array<struct<start:int,end:int>>, inserted array<struct<start:int,end:int>>")
    assert [tuple(s) for s in review.marked_segments(rows).first().segments] == [("delete", "a"), ("both", "b"), ("insert", "c"), ("normal", "d")]
    assert [r[0] for r in spark.createDataFrame([("a\nb", True), ("x" * 25, False), (None, True)], "t string, h boolean").select(review.row_height(F.col("t"), 10, F.col("h"))).collect()] == [36, 51, 24]


def test_states(spark):
    import datetime

    now = datetime.datetime(2024, 1, 1)
    before = ledger.source_state(spark.createDataFrame([("a", bytearray(b"x"), now), ("b", bytearray(b"y"), now)], "path string, content binary, modificationTime timestamp"))
    after = ledger.source_state(spark.createDataFrame([("a", bytearray(b"x"), now), ("b", bytearray(b"z"), now)], "path string, content binary, modificationTime timestamp"))
    assert [r.path for r in ledger.changed_inputs(before, after).collect()] == ["b"] and ledger.changed_inputs(before, before).count() == 0
    assert structure.header_spans("Article 12 (Fee)", "12", "Fee") == (8, 10, 12, 15) and structure.header_spans("x", "", "y") == (-1, -1, -1, -1)


def test_formatting_changes(spark):
    from textloom.sources.docx import formatting_changes, named_styles_col, run_changes, run_styles_col, style_changes, styles_col, table_format_changes
    from tests_docx import p, package

    table = lambda w: f"<w:tbl><w:tblGrid><w:gridCol w:w='{w}'/></w:tblGrid><w:tr><w:tc>{p('cell', '')}</w:tc></w:tr></w:tbl>"
    two = "<w:p><w:pPr><w:pStyle w:val='A'/></w:pPr><w:r><w:t>plain </w:t></w:r><w:r><w:rPr>{}</w:rPr><w:t>word</w:t></w:r></w:p>"
    style = "<w:style w:styleId='A' w:rsid='{}'><w:rPr><w:sz w:val='{}'/></w:rPr></w:style>{}"
    raws = [package(p("same", "<w:b/>") + p("other", "") + two.format("") + table(10), style.format(1, 20, "")), package(p("same", "<w:i/>") + p("other", "") + two.format("<w:u w:val='single'/>") + table(12), style.format(2, 20, "<w:style w:styleId='B'/>"))]
    files = [spark.createDataFrame([(1, bytearray(r))], "doc_id int, content binary") for r in raws]
    got = formatting_changes(*[f.select("doc_id", styles_col("content").alias("styles")) for f in files]).collect()
    assert [(r.text, '"bold":true' in r.old, '"italic":true' in r.new) for r in got] == [("same", True, True)]
    got = run_changes(*[f.select("doc_id", run_styles_col("content").alias("runs")) for f in files]).collect()
    assert {(r.text, '"underline":true' in r.new, '"half_points":"20"' in r.new) for r in got} == {("same", False, False), ("word", True, True)}
    assert [tuple(r) for r in style_changes(*files).collect()] == [(1, "B", "added")] and files[0].select(named_styles_col("content")[0].id).first()[0] == "A"
    assert [tuple(r) for r in table_format_changes(*files).collect()] == [(1, 0, "modified")]


def test_inline_labels_and_breaks():
    labels = lambda t: [x[0] for x in structure.parts(t)]
    assert labels("(1) one (2) two") == ["(1)", "(2)"]  # two, the first of which opens the line
    assert labels("see (1) and (2) here") == [""] and labels("lead (1) a (2) b (3) c") == ["", "(1)", "(2)", "(3)"]
    assert labels("(1) one\nsee (2) two") == ["(1)"]
    assert structure.recover_breaks("The end. 제3조(목적) text") == "The end.\n제3조(목적) text" and structure.recover_breaks("under Article 3 (x)") == "under Article 3 (x)"


def test_projection():
    assert diff.project("alpha beta", "alpha gamma beta", 5) == 5 and diff.project("alpha beta", "alpha gamma beta", 8) == 14
    assert diff.project("xaby", "zabw", 2) == 2 and diff.project("abc", "", 2) == 0  # no word in common: by characters
    assert diff.project("One. Two", 'One." Two', 4) == 5


def test_additions_votes_anchors_and_counters(spark):
    from textloom.operators import align, symbols

    add = [("c", 1, 1, 5, "article", "5", "Term", "the term is one year"), ("c", 1, 2, 6, "article", "6", "Term", "the term is one year long"), ("c", 1, 2, 7, "article", "7", "Fees", "ten euros"), ("c", 2, 1, 9, "article", "9", "Term", "the term is one year")]
    got = {(r.slot, r.row, r.doc, r.unit_ix) for r in align.merged_additions(spark.createDataFrame(add, "comparison_id string, slot int, doc int, unit_ix int, kind string, number string, title string, body string")).collect()}
    assert got == {(1, 1, 1, 5), (1, 1, 2, 6), (1, 2, 2, 7), (2, 1, 1, 9)}
    votes = spark.createDataFrame([("c", 1, 1)] * 3 + [("c", 1, 2)] * 2 + [("c", 2, 1)] * 2 + [("c", 2, 2)], "k string, o int, n int")
    assert {(r.o, r.n, r.votes) for r in align.greedy_votes(votes, ("k",), "o", "n").collect()} == {(1, 1, 3), (2, 2, 1)}
    assert align.paragraph_anchors(["a", "b", "b", "c"], ["c", "a", "b"], [(1, 2), (0, 2)]) == [(0, 1), (1, 2)]
    files = symbols.parse_symbols(spark.createDataFrame([("a.rs", "fn a() {}"), ("b.rs", "fn {"), ("c.txt", "x")], "path string, content string"))[1]
    assert tuple(symbols.scan_counters(files, spark.range(3), 1).first()) == (1, 1, 3, True)


def test_expressions_are_the_kernels(spark):
    """Built-in expressions give what the kernels on plain values give."""
    from textloom.operators.structure import header_spans, header_spans_col

    texts = ["iv", "XIV", "iiii", "", "mcmxciv", "vx", "12", " 12-3", "12의3", "7. ", "x.", "ix ", "...a b", "a.", "—x", "mmmm"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(tx.roman_value_col(F.col("t")), tx.section_number_col(F.col("t")), tx.split_punctuation_col(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(tx.roman_value(t), tx.section_number(t), tx.split_punctuation(t)) for t in texts]
    rows = [("Article 12 (Fee)", "12", "Fee"), ("😀 1 x 1", "1", "1"), ("x", "", "y"), ("", "", ""), ("a b", "b", "a")]
    got = spark.createDataFrame(rows, "h string, n string, t string").select(header_spans_col(F.col("h"), F.col("n"), F.col("t")).alias("s")).collect()
    assert [tuple(r.s) for r in got] == [header_spans(*r) for r in rows]
