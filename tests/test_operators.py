"""Ledgers, symbols, structure, alignment and review on small tables."""

import pandas as pd
from pyspark.sql import functions as F

from textloom.operators import align, ledger, review, structure, symbols


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_file_ledger(spark):
    sh = "path string, sha string"
    before = spark.createDataFrame([("same", "1"), ("edit", "2"), ("old", "3"), ("gone", "4"), ("dup1", "5"), ("dup2", "5")], sh)
    after = spark.createDataFrame([("same", "1"), ("edit", "9"), ("new", "3"), ("add", "7"), ("dup3", "5")], sh)
    got = {(r.kind, r.before_path, r.after_path) for r in ledger.file_ledger(before, after).collect()}
    assert got == {("modified", "edit", "edit"), ("renamed", "old", "new"), ("deleted", "gone", None), ("added", None, "add"), ("deleted", "dup1", None), ("deleted", "dup2", None), ("added", None, "dup3")}
    tree = before.unionByName(spark.createDataFrame([("keep", "3")], sh)), after.unionByName(spark.createDataFrame([("keep", "3")], sh))
    assert not [r for r in ledger.file_ledger(*tree, whole_tree=True).collect() if r.kind == "renamed"]
    assert [r for r in ledger.file_ledger(*tree).collect() if r.kind == "renamed"]


def test_rename_candidates_and_blobs(spark):
    sh = "path string, sha string, content string"
    before = spark.createDataFrame([("a.rs", "1", "fn one() { let x = 1; }")], sh)
    after = spark.createDataFrame([("b.rs", "2", "fn one() { let x = 2; }")], sh)
    led = ledger.file_ledger(before.select("path", "sha"), after.select("path", "sha"))
    assert [(r.before_path, r.after_path) for r in ledger.rename_candidates(led, before, after).collect()] == [("a.rs", "b.rs")]
    files = spark.createDataFrame([("x",), ("x",), (None,)], "content string")
    blobs = ledger.missing_blobs(files, spark.createDataFrame([], "sha string"))
    assert blobs.count() == 2
    versions = blobs.select("sha").unionByName(spark.createDataFrame([("none",)], "sha string"))
    assert sorted(r.state for r in ledger.resolve_versions(versions, blobs).collect()) == ["missing", "ok", "ok"]


def test_ast_diff_and_moves(spark):
    f = "path string, content string"
    body = "{ let total = items.iter().map(|i| i.price * i.count).sum(); log(total); total + tax(total) - discount }"
    before = symbols.parse_symbols(spark.createDataFrame([("a.rs", f"fn one() {{ go(1); }}\nfn two() {{ go(2); }}\nfn sum() {body}\n"), ("b.rs", "fn z() { q(); }\n")], f))[0]
    after = symbols.parse_symbols(spark.createDataFrame([("a.rs", "fn one() { go(3); }\nfn deux() { go(2); }\nfn new() { n(); }\n"), ("b.rs", f"fn z() {{ q(); }}\nfn sum() {body}\n")], f))[0]
    got = {(r.change, r.before_name, r.after_name) for r in symbols.ast_diff(before, after).where("path = 'a.rs'").collect()}
    assert got == {("modify", "one", "one"), ("rename", "two", "deux"), ("delete", "sum", None), ("add", None, "new")}
    led = ledger.file_ledger(*[d.groupBy("path").agg(F.sha2(F.concat_ws("", F.collect_list("source")), 256).alias("sha")) for d in (before, after)])
    assert [(r.before_path, r.after_path, r.before_name, r.how) for r in symbols.symbol_moves(before, after, led).collect()] == [("a.rs", "b.rs", "sum", "exact")]


LEGAL = "Preamble text.\nChapter 1 General\nArticle 1 (Purpose)\nThis is why.\n(1) first item\n(2) second item\nArticle 2 (Scope)\nThis applies.\nArticle 9 (Odd)\nx\nArticle 3 (Fee)\nPay. Article 4. Term\n"


def test_units_and_parts(spark):
    got = structure.units(LEGAL)
    assert [(u[0], u[1], u[2]) for u in got if u[0] == "article"][:2] == [("article", "1", "Purpose"), ("article", "2", "Scope")]
    assert "9" not in [u[1] for u in got if u[0] == "article"] and got[0][0] == "preamble"
    assert got[-1][1] == "4"
    assert [u[0] for u in structure.units("1. First Part\nsome text\n2. Second Part\nmore")] == ["section", "section"]
    assert structure.units("") == []
    p = structure.parts("Lead\n(1) one\n  a. sub\n(2) two")
    assert [x[0] for x in p] == ["", "(1)", "a.", "(2)"] and p[1][5] == "one"
    df = structure.parse_parts(spark.createDataFrame([(1, 0, "Lead\n(1) one\n  a. sub\n(2) two\n")], "doc_id long, unit_ix int, body string"))
    levels = {r.label: (r.level, r.parent) for r in structure.part_levels(df).collect()}
    assert levels["(1)"] == (1, -1) and levels["a."] == (2, 1) and levels["(2)"] == (1, -1)


def unit(n, title, body):
    return ("article", str(n), title, body)


def test_unit_alignment(spark):
    old = pd.DataFrame([unit(1, "Purpose", "why we do this"), unit(2, "Scope", "where it applies to all"), unit(3, "Fees", "the fee is ten euros a year")], columns=["kind", "number", "title", "body"])
    new = pd.DataFrame([unit(1, "Fees", "the fee is twelve euros a year"), unit(2, "Purpose", "why we do this"), unit(3, "Scope", "where it applies to all")], columns=["kind", "number", "title", "body"])
    got = {(i, j): m for i, j, _, m in align.align_units(old, new)}
    assert set(got) == {(0, 1), (1, 2), (2, 0)} and set(got.values()) == {"moved"}
    u = spark.createDataFrame([("p", s, i, *row) for s, t in ((0, old), (1, new)) for i, row in enumerate(t.itertuples(index=False))] + [("e", s, 0, "block", "", "", "x") for s in (0, 1)], "comparison_id string, doc_ord int, unit_ix int, kind string, number string, title string, body string")
    assert align.match_units(u).count() == 4


def frame(*rows):
    return pd.DataFrame(rows, columns=["kind", "number", "title", "body"])


def test_unit_alignment_of_long_bodies():
    """Bodies are scored whole: what follows 2,048 equal characters counts, and so does what follows a new opening."""
    words = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    score = lambda a, b: next((s for _, _, s, _ in align.align_units(frame(("block", "", "", a)), frame(("block", "", "", b)))), 0.0)
    head, tail = words("x", 500), words("c", 900)
    assert len(head) > 2048
    assert score(f"{head} {tail}", f"{head} {words('z', 900)}") == 0.0  # 500 of 1,400 words
    assert score(tail, f"{words('y', 300)} {tail}") == 2 * 900 / 2100
    article = lambda body: frame(("article", "1", "Fees", body))
    e = align.Evidence(align.Units(article(f"{head} {tail}")), align.Units(article(f"{head} {words('z', 900)}")))
    from textloom.functions.similarity import indel_ratio

    a, b = e.a.body_key[0], e.b.body_key[0]
    assert e.body(0, 0) >= indel_ratio(a, b) and e.body(0, 0) < 1.0


def test_articles():
    old = frame(("article", "1", "Purpose", "why we do this"), ("article", "2", "General", "common words here"), ("article", "3", "Fees", "ten euros a year"), ("section", "1", "Part", "lead"), ("article", "4", "Term", "the term is a year"))
    new = frame(("article", "1", "Purpose", "why we do that"), ("article", "2", "Fees and costs", "twelve euros a year"), ("article", "3", "General", "nothing in common at all"), ("section", "1", "Section", "lead"), ("article", "5", "Period", "the term is a year"))
    got = {(i, j): (round(s, 3), m) for i, j, s, m in align.align_units(old, new)}
    # Titles are anchors; a title that says little is none; what only its number changed is renumbered.
    assert got[0, 0][1] == "same" and (1, 2) not in got and got[4, 4][1] == "renumbered" and got[3, 3][1] == "same"
    assert got[2, 1][1] in ("renumbered", "moved")
    swapped = {(i, j): m for i, j, _, m in align.align_units(frame(("article", "1", "Alpha", "a b c"), ("article", "2", "Beta", "d e f")), frame(("article", "1", "Beta", "d e f"), ("article", "2", "Alpha", "a b c")))}
    assert swapped == {(0, 1): "moved", (1, 0): "moved"}


def brute_cheapest(n, m, cost, gap):
    """Least total of all order-preserving alignments."""
    best = {}
    for i in range(n, -1, -1):
        for j in range(m, -1, -1):
            ways = [0.0] if i == n and j == m else []
            if i < n and j < m:
                ways.append(cost[i][j] + best[i + 1, j + 1])
            if i < n:
                ways.append(gap + best[i + 1, j])
            if j < m:
                ways.append(gap + best[i, j + 1])
            best[i, j] = min(ways)
    return best[0, 0]


def test_cheapest_and_generic_pairs():
    import random

    rng = random.Random(1)
    for _ in range(200):
        n, m = rng.randint(0, 6), rng.randint(0, 6)
        cost = [[rng.choice((0.0, 0.2, 0.5, 1.08, 2.0)) for _ in range(m)] for _ in range(n)]
        pairs = align.cheapest(n, m, lambda i, j: cost[i][j])
        assert all(p < q and r < s for (p, r), (q, s) in zip(pairs, pairs[1:]))
        total = sum(cost[i][j] for i, j in pairs) + align.GAP * (n + m - 2 * len(pairs))
        assert abs(total - brute_cheapest(n, m, cost, align.GAP)) < 1e-9
    # The second text's best is taken, so it stays alone; the queue of large inputs goes on to its next one.
    old, new = ["a b c d", "a b c d e"], ["a b c d", "a b c x y"]
    assert align.generic_pairs(old, new) == [(0, 0, 1.0)] and align.generic_pairs(old, new, pairs=0) == [(0, 0, 1.0), (1, 1, 0.6)]


def test_match_units_as_a_table(spark):
    units = [("p", s, i, "article", str(n), t, b) for s, rows in enumerate(((("1", "Alpha", "a b c"), ("2", "Beta", "d e f")), (("1", "Beta", "d e f g"), ("2", "Alpha", "a b c")))) for i, (n, t, b) in enumerate(rows)]
    units += [("q", s, 0, "block", "", "", "x y") for s in (0, 1)] + [("r", 0, 0, "block", "", "", "alone")]
    df = spark.createDataFrame(units, "comparison_id string, doc_ord int, unit_ix int, kind string, number string, title string, body string")
    got = {(r.comparison_id, r.old_ix, r.new_ix, r.mode) for r in align.match_units(df).collect()}
    assert got == {("p", 0, 1, "moved"), ("p", 1, 0, "moved"), ("q", 0, 0, "same")}
    side = lambda s: df.where(F.col("doc_ord") == s)
    assert {(r.old_ix, r.new_ix) for r in align.unique_titles(side(0), side(1)).collect()} == {(0, 1), (1, 0)}


def test_cells_meet_cells_only():
    cell = lambda t, r, c, text: {"kind": "cell", "number": "", "title": "", "body": text, "table": t, "row": r, "col": c}
    block = {"kind": "block", "number": "", "title": "", "body": "name of the item", "table": None, "row": None, "col": None}
    old = pd.DataFrame([block, cell(0, 0, 0, "name"), cell(0, 0, 1, "price"), cell(0, 1, 0, "tea"), cell(0, 1, 1, "3")])
    new = pd.DataFrame([cell(0, 0, 0, "name"), cell(0, 0, 1, "price"), cell(0, 1, 0, "tea"), cell(0, 1, 1, "4"), block])
    got = {(i, j) for i, j, _, _ in align.align_units(old, new)}
    assert got == {(0, 4), (1, 0), (2, 1), (3, 2), (4, 3)}


def item(label, core, level=1, parent=-1, family="paren_number", ordinal=None):
    from textloom.operators.parts import Item

    return Item(label, family if label else "body", ordinal, level if label else 0, parent, core)


def test_part_selections():
    from textloom.operators import parts

    # Moves: the best rank first; children count for little-alike ones.
    assert parts.select_moves([(0, 0, 0.8, 0, 0), (0, 1, 0.9, 0, 0), (1, 1, 0.85, 0, 0), (2, 2, 0.5, 0, 1), (3, 2, 0.56, 0, 1), (4, 4, 0.1, 0.9, 0)]) == [(0, 1, 0.9), (4, 4, 0.94 * 0.9), (3, 2, 0.56 + 0.06)]
    # Same ordinal: an old item asks its best free one only, and shape goes before rank.
    assert parts.select_same_ordinal([(0, 0, 0.9, 0, False, False), (0, 1, 0.25, 0, True, False), (1, 1, 0.7, 0, False, False), (1, 2, 0.61, 0, False, False)]) == [(0, 1, 0.58)]
    assert parts.select_same_label([(0, 0, 0.1, False, False), (1, 0, 0.1, True, False), (2, 1, 0.18, False, False)]) == [(1, 0, 0.52), (2, 1, 0.52)]
    assert parts.select_across([(0, 0, 0.34, 0, True, False), (1, 1, 0.34, 0, False, False), (2, 0, 0.3, 0.5, True, False)]) == [(2, 0, 0.56)]
    assert parts.exact_pairs(["a", "b", "a", ""], ["b", "a", "a", ""]) == [(0, 1), (1, 0), (2, 2)]


def test_parts_of_two_bodies(spark):
    from textloom.operators import parts

    pairs = lambda a, b: {(i, j) for i, j, _ in parts.match_parts(a, b)}
    old = [item("(1)", "pay the fee", ordinal=1), item("(2)", "send the form", ordinal=2)]
    assert pairs(old, [item("(1)", "send the form", ordinal=1), item("(2)", "pay the fee now please", ordinal=2)]) == {(0, 1), (1, 0)}
    # A list against prose: only the lead texts, and only if alike.
    lead = [item("", "The buyer pays on time."), item("(1)", "one", ordinal=1), item("(2)", "two", ordinal=2)]
    assert pairs(lead, [item("", "The buyer pays on time always.")]) == {(0, 0)} and pairs(lead, [item("", "zzz")]) == set()
    # A quoted head holds a rewritten definition; an item below a lost layer is found a level up.
    assert pairs([item("(1)", '"fee" means what is paid', ordinal=1), item("(2)", "other x", ordinal=2)], [item("(1)", "new words here", ordinal=1), item("(2)", '"fee" is due', ordinal=2)]) >= {(0, 1)}
    deep = [item("5.", "wrapper text alone", 1, -1, "number", 5), item("a.", "first inner item of some length", 2, 0, "alpha", 1), item("6.", "kept as it is", 1, -1, "number", 6)]
    assert pairs(deep, [item("1.", "first inner item of some length now", 1, -1, "number", 1), item("2.", "kept as it is", 1, -1, "number", 2)]) >= {(1, 0), (2, 1)}
    many = [item(f"({i})", f"item {i}", ordinal=i) for i in range(300)]
    assert len(parts.match_parts(many, many[::-1])) == 300 and parts.match_parts([], many) == []
    body = lambda t: structure.part_levels(structure.parse_parts(spark.createDataFrame([("c", 0, t)], "comparison_id string, unit_ix int, body string"), keys=("comparison_id", "unit_ix")), ("comparison_id", "unit_ix"))
    got = parts.match_part_lists(body("Lead\n(1) one fee\n(2) two forms"), body("Lead\n(1) two forms\n(2) one fee\n(3) new"), ("comparison_id", "unit_ix")).collect()
    assert {(r.old_ix, r.new_ix, r.limited) for r in got} == {(0, 0, False), (1, 2, False), (2, 1, False)}


def test_scored_units(spark):
    from textloom.functions.similarity import body_score, scored_units, structure_score, title_score, unit_score
    from textloom.functions.text import structure_counts, title_concept_set

    rows = [("Fees", "Fee", "pay ten euros", "pay two euros", "1", "1"), ("", "x", "(1) a\n", "(2) b\n", "1", None), ("Payment obligations", "Obligations of payment", "same", "same", None, None), (None, None, None, "", "a", "A")]
    df = spark.createDataFrame(rows, "old_title string, new_title string, old_body string, new_body string, old_number string, new_number string")
    words = lambda t: set(__import__("re").findall(r"[0-9]+(?:[.,][0-9]+)*|[^\W\d_]\w*", t.lower()))
    key = align.lineage_key
    for r, row in zip(scored_units(df).collect(), rows):
        ot, nt, ob, nb, on, nn = (x or "" for x in row)
        title, body = title_score(key(ot), key(nt), title_concept_set(ot), title_concept_set(nt)), body_score(key(ob), key(nb), words(ob), words(nb))
        structure = structure_score(structure_counts(ob), structure_counts(nb))
        assert (r.title, r.body, r.structure) == (title, body, structure)
        assert abs(r.lineage - unit_score(title, body, structure, on.lower() == nn.lower(), bool(key(ot) and key(nt)))) < 1e-12


def test_selections():
    c = [(0, 0, 0.9), (0, 1, 0.8), (1, 0, 0.85), (1, 1, 0.2)]
    assert align.greedy(c, 0.5) == [(0, 0, 0.9)]
    assert align.mutual_best([(0, 0, 0.95), (0, 1, 0.7), (1, 1, 0.9), (2, 2, 0.9), (2, 3, 0.85)]) == [(0, 0, 0.95, True), (1, 1, 0.9, True), (2, 2, 0.9, False)]
    assert align.longest_increasing([(0, 2), (1, 0), (2, 1)]) == [(1, 0), (2, 1)]
    a, b = ["the first line", "gone", "the last line"], ["the first line", "the last line here"]
    assert align.paragraphs(a, b) == [(0, 0), (2, 1)] == align.paragraphs(a, b, cells=1)
    tables, cells = align.match_tables([{"rows": [["k", "v"], ["a", "1"]]}], [{"rows": [["k", "v"], ["a", "2"]]}])
    assert tables[0][:2] == (0, 0) and cells[0, 0] == [(0, 0), (1, 1)]


def test_review(spark):
    pairs = spark.createDataFrame([(1, "one two", "one 2"), (2, None, "new"), (3, "same", "same"), (4, "old", "")], "pair_id int, old string, new string")
    got = {(r.pair_id, r.kind, r.old_text, r.new_text) for r in review.compare_pairs(pairs).collect()}
    assert got == {(1, "change", "two", "2"), (2, "insert", "", "new"), (4, "delete", "old", "")}
    m = spark.createDataFrame([("c", 0, 1), ("c", 1, 0), ("c", 2, 2)], "k string, old_ix int, new_ix int")
    assert [r.crossed for r in review.moved_rows(m, ("k",)).orderBy("old_ix").collect()] == [True, True, False]
    assert review.pair_plan(3, first_to_last=True) == [(0, 1), (1, 2), (0, 2)] and review.pair_plan(2, 1) == [(1, 0)]
    lines = spark.createDataFrame([("p", 0, 0, 5), ("p", 1, 5, 9)], "p string, line_no int, start int, end int")
    marks = spark.createDataFrame([("p", 2, 4, 6, "b"), ("p", 1, 9, 9, "a")], "p string, num int, start int, end int, message string")
    assert {r.line_no: list(r.messages) for r in review.messages_on_lines(lines, marks, ("p",)).collect()} == {0: ["b"], 1: ["a", "b"]}
    from textloom.operators.diff import diff_lines

    files = spark.createDataFrame([(1, "a\nb😀\n", "a\nc\n")], "pair_id int, before string, after string")
    hunks = diff_lines(files)
    at = [review.line_offsets(files.select("pair_id", F.col(c).alias("content")), ("pair_id",)) for c in ("before", "after")]
    r = review.located(hunks, *at).first()
    assert (r.before_byte_start, r.before_byte_end, r.before_utf16_end, r.after_byte_end) == (2, 8, 6, 4)
    g = align.grid(spark.createDataFrame([("c", 0), ("c", 1)], "comparison_id string, unit_ix int"), spark.createDataFrame([("c", 1, 0, 0), ("c", 1, 1, 2)], "comparison_id string, doc int, base_ix int, other_ix int"), spark.createDataFrame([("c", 1, 0), ("c", 1, 1), ("c", 1, 2)], "comparison_id string, doc int, unit_ix int"))
    assert [(r.base_ix, r.other_ix) for r in g.orderBy("row_id").collect()] == [(0, 0), (None, 1), (1, 2)]


def test_missing_units_and_collapsed_wrappers(spark):
    from textloom.operators import review

    units = spark.createDataFrame([("c", 0, "h", "b"), ("c", 1, "h1", " ")], "comparison_id string, unit_ix int, header string, body string")
    met = spark.createDataFrame([("c", 0, 0)], "comparison_id string, old_ix int, new_ix int")
    assert [(r.unit_ix, r.part, r.kind, r.text) for r in review.missing_units(units, met).collect()] == [(1, "header", "delete", "h1")]
    part = lambda rows: spark.createDataFrame([(u, i, lv, c) for u, items in rows.items() for i, (lv, c) in enumerate(items)], "u string, part_ix int, level int, core string")
    old = part({"yes": [(1, "a"), (1, "wrap"), (2, "x"), (2, "y"), (1, "z")], "leaf": [(1, "a"), (1, "b")], "edited": [(1, "w"), (2, "x")], "last": [(1, "w"), (2, "x")], "gone": [(1, "only")]})
    new = part({"yes": [(1, "a"), (1, "x"), (1, "y"), (1, "z")], "leaf": [(1, "a")], "edited": [(1, "other")], "last": [(1, "x")]})
    assert sorted(map(tuple, review.collapsed_wrappers(old, new, ("u",)).collect())) == [("last", 0), ("yes", 1)]


def test_windows_of_orders_get_tasks_by_rows(spark, tmp_path, monkeypatch):
    """A larger table is dealt over more tasks, so that the sorts of one task don't grow with it."""
    from textloom import storage
    from textloom.plans import registry

    monkeypatch.setattr(storage, "TASK_ROWS", 50)
    lines = spark.range(1000).selectExpr("id DIV 4 AS l_orderkey", "CAST(id % 4 AS INT) AS l_linenumber", "id AS l_partkey", "id AS l_suppkey", "timestamp_seconds(id * 7919 % 1000) AS l_shipdate", "IF(id % 3 = 0, 'O', 'F') AS l_linestatus")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    for query in (registry.moved_rows, registry.marker_numbers):
        out = query(spark, str(tmp_path))
        assert out.rdd.getNumPartitions() == 20 and out.count() == 1000


def test_batches_of_long_texts_are_bounded(spark):
    """Columns and operators in Python end their Arrow batches by bytes, whatever the session had; a smaller setting stays."""
    from textloom.functions.text import match_key_col
    from textloom.operators.align import match_units
    from textloom.sources.decode import decode_col
    from textloom.storage import BATCH_BYTES

    name, units = "spark.sql.execution.arrow.maxBytesPerBatch", spark.createDataFrame([], "comparison_id int, doc_ord int, unit_ix int, kind string, number string, title string, body string")
    for use in (lambda: match_key_col("t"), lambda: decode_col("t"), lambda: match_units(units)):
        for given, want in ((BATCH_BYTES * 8, BATCH_BYTES), (1000, 1000)):
            spark.conf.set(name, str(given))
            use()
            assert spark.conf.get(name) == str(want)
        spark.conf.unset(name)


def test_long_lists_are_matched_as_short_ones(monkeypatch):
    """No number of items changes how they are matched, and neither does how many candidates are held."""
    from textloom.operators import compare, parts

    from hashlib import sha1

    code = lambda i: sha1(b"%d" % i).hexdigest()[:24]
    old = [item(f"({i})", f"{code(i)} is due", ordinal=i) for i in range(270)]
    new = [item(f"({i})", f"{x.core} now", ordinal=i) for i, x in enumerate([old[-1], *old[:-1]])]
    assert [(i, j) for i, j, _ in parts.match_parts(old, new)] == [(i, (i + 1) % 270) for i in range(270)]
    alike = [item("-", f"a fee {'x' * (i % 5)}") for i in range(20)], [item("*", f"a fee {'y' * (i % 7 + 1)}") for i in range(20)]
    got = parts.match_parts(*alike)
    monkeypatch.setattr(parts, "KEPT", 1)
    assert got and got == parts.match_parts(*alike)
    text = lambda tail: "\n".join(f"({i}) {code(i)} is due {tail}" for i in range(1, 271))
    markers, _ = compare._body_markers(text("late"), text("now"), (0, 0), True)
    assert {m[2] for m in markers} == set(range(270)) and not any(code(i) in m[8] + m[9] for m in markers for i in (1, 100, 270))
