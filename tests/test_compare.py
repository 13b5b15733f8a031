"""Whole comparisons, mapping of changes, declarations."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.operators import compare, ledger, mapping, review, symbols
from textloom.operators.compare import Unit

A = "Article 1 (Purpose)\nWhy we do this.\nArticle 2 (Fees)\nThe fee is ten euros.\n(1) due monthly\n(2) paid by card\nArticle 3 (Old)\nGone away text.\n"
B = "Article 1 (Purpose)\nWhy we do that.\nArticle 2 (New part)\nSomething wholly different is said.\nArticle 3 (Fees)\nThe fee is ten euros.\n(1) paid by card\n(2) due monthly\n"


def cut(text, start, end):
    return text.encode("utf-16-le")[2 * start : 2 * end].decode("utf-16-le")


def test_markers_are_places():
    """Every marker's texts stand at its places in the unit."""
    unit = lambda n, t, b: Unit(0, "article", n, t, f"Article {n} ({t})", b)
    pairs = [
        (unit("1", "Purpose", "Lead 😀 text.\n(1) first item here\n(2) second item here"), unit("2", "Purposes", "Lead 😀 text.\n(1) first item there\n(2) wholly new words come\n(3) second item here")),
        (unit("1", "Fee", "short old"), unit("1", "Fee", "other thing")),
        (unit("4", "Fee", "(1) a b c\n  a. sub one\n  b. sub two"), unit("4", "Fee", "(1) a b c\n(2) sub one")),
        (unit("5", "Fee", "a  b\nc"), unit("5", "Fee", "a b c")),
    ]
    for old, new in pairs:
        markers, _ = compare.compare_pair(old, new)
        assert markers
        for kind, part, _, _, p, q, r, s, x, y in markers:
            a, b = f"{old.header} {old.body}", f"{new.header} {new.body}"
            assert cut(a, p, q) == x or not x and p == q
            assert cut(b, r, s) == y or not y and r == s
            assert kind in ("number", "label", "change", "delete", "insert") and part in ("header", "body")
    markers, messages = compare.compare_pair(*pairs[0])
    assert messages[0] == ("status", "moved and changed", "") and ("renumbered", "Article 1 (Purpose)", "Article 2 (Purposes)") in messages
    assert [m[0] for m in compare.compare_pair(*pairs[1])[0]] == ["change"]  # a short body written anew is one change
    same = unit("1", "Fee", "x")
    assert compare.compare_pair(same, same) == ([], [])
    cell = lambda body, span: Unit(0, "cell", "", "", "[1:1:1]", body, "", 0, 0, 0, span, "none", 1)
    markers, messages = compare.compare_pair(cell("a b", 1), cell("a c", 2))
    assert [m[-2:] for m in markers] == [("b", "c")] and messages == [("cell merge", "[1:1:1]", "[1:1:1]")]


def test_compare_texts(spark):
    df = spark.createDataFrame([("c", A, B), ("d", A, A), ("e", A, ""), ("f", None, "x")], "comparison_id string, old string, new string")
    pairs, markers, messages = compare.compare_texts(df)
    got = {(r.comparison_id, r.old_ix, r.new_ix, r.mode, r.changed) for r in pairs.where("comparison_id = 'c'").collect()}
    assert got == {("c", 0, 0, "same", True), ("c", None, 1, None, True), ("c", 1, 2, "moved", True), ("c", 2, None, None, True)}
    assert not pairs.where("comparison_id = 'd' AND changed").count() and pairs.where("comparison_id = 'e' AND old_ix IS NOT NULL").count() == 3 and pairs.where("comparison_id = 'f'").count() == 1
    rows = markers.where("comparison_id = 'c'").orderBy("row_id", "num").collect()
    assert [(r.kind, r.old_text, r.new_text) for r in rows if r.row_id == 1] == [("change", "this", "that")]
    assert {r.kind for r in rows if r.row_id == 4} == {"delete"} and [r.num for r in rows if r.row_id == 3] == [1, 2, 3]
    shown = mapping.concrete_messages(messages)
    assert {(r.row_id, r.code) for r in shown.where("comparison_id = 'c'").collect()} == {(3, "renumbered"), (3, "item moved")}
    told = {r.row_id: (r.first_place, list(r.messages)) for r in mapping.row_summaries(markers, messages).where("comparison_id = 'c'").collect()}
    assert told[1] == (30, ["Status: changed"]) and told[3][1][0] == "Status: moved and changed" and told[4][1] == []
    nums = [r.num for r in mapping.renumbered(markers).where("comparison_id = 'c'").orderBy("num").collect()]
    assert nums == list(range(1, len(nums) + 1))
    places = review.placements(markers.withColumns({"old_header": F.lit(0), "new_header": F.lit(0)}))
    assert places.count() == 2 * markers.count()


def test_block_units():
    par = lambda t: (t, None, None, None, None, None, None, None, None, 1)
    cell = lambda t, r, c: (t, 0, r, c, 1, "none", None, None, None, 1)
    got = compare.block_units([par("Article 1 (One)"), par("text"), cell("k", 0, 0), cell("v", 0, 1), par("Article 2 (Two)"), par("more")])
    assert [(u[0], u[1], u[2], u[5]) for u in got] == [(0, "article", "1", "text"), (1, "cell", "", "k"), (2, "cell", "", "v"), (3, "article", "2", "more")]
    assert got[2][7:10] == (0, 0, 1) and got[0][7] is None


def test_table_moves(spark):
    cols = "comparison_id string, old_ix int, new_ix int, old_table int, old_row int, old_col int, new_table int, new_row int, new_col int"
    rows = [
        ("text", 0, 2, None, None, None, None, None, None), ("text", 1, 0, 0, 0, 0, 0, 0, 0), ("text", 2, 1, 0, 0, 1, 0, 0, 1),
        ("rows", 0, 1, 0, 0, 0, 0, 1, 0), ("rows", 1, 0, 0, 1, 0, 0, 0, 0), ("rows", 2, 2, 0, 2, 0, 0, 2, 0),
        ("tables", 0, 1, 0, 0, 0, 1, 0, 0), ("tables", 1, 0, 1, 0, 0, 0, 0, 0), ("still", 0, 0, 0, 0, 0, 0, 0, 0),
    ]
    got = {(r.comparison_id, r.old_ix, r.new_ix, r.reason) for r in mapping.table_moves(spark.createDataFrame(rows, cols)).collect()}
    assert got == {("text", 1, 0, "table moved"), ("rows", 0, 1, "row moved"), ("rows", 1, 0, "row moved"), ("tables", 0, 1, "table moved"), ("tables", 1, 0, "table moved")}


def test_code_events(spark):
    old, new = "fn one() { go(1); }\nfn two() { go(2); }\nfn gone() { x(); }\n", "// top\nfn one() { go(3); }\nfn deux() { go(2); }\n"
    files = lambda t: spark.createDataFrame([("a.rs", t)], "path string, content string")
    changes = symbols.ast_diff(symbols.parse_symbols(files(old))[0], symbols.parse_symbols(files(new))[0])
    lines = [review.line_offsets(files(t)) for t in (old, new)]
    hunks = spark.createDataFrame([("a.rs", 1), ("a.rs", 2)], "path string, ord int")
    got = [(r.ord, r.change, r.name, r.side, r.line_no) for r in mapping.symbol_events(changes, *lines, hunks).orderBy("ord").collect()]
    assert got == [(3, "modify", "one", "after", 1), (4, "rename", "deux", "after", 2), (5, "delete", "gone", "before", 2)]
    points = spark.createDataFrame([("a.rs", 0), ("a.rs", 19), ("a.rs", 20), ("a.rs", len(old)), ("a.rs", 999)], "path string, byte int")
    assert [r.line_no for r in mapping.lines_of(points, lines[0]).orderBy("byte").collect()] == [0, 0, 1, 2, None]
    led = ledger.file_ledger(spark.createDataFrame([("x", "1")], "path string, sha string"), spark.createDataFrame([("y", "1")], "path string, sha string"))
    moves = spark.createDataFrame([("a.rs", "b.rs", "function", "f", "g", "renamed", 970)], "before_path string, after_path string, kind string, before_name string, after_name string, how string, permille int")
    assert sorted((r.kind, r.location, r.evidence) for r in mapping.folder_events(led, moves).collect()) == [("moved", "f -> g", "renamed, 970 permille"), ("renamed", "file", "equal content, unique on both sides")]
    shown = mapping.excerpts(spark.createDataFrame([(1, n) for n in range(6)], "pair_id int, line_no int"), spark.createDataFrame([(1, 1, 1, 3), (1, 2, 4, 4), (1, 3, 5, 6)], "pair_id int, ord int, after_start int, after_end int"))
    assert [r.hunk_ord for r in shown.orderBy("line_no").collect()] == [None, 1, 1, None, None, 3]


def test_small_mappings(spark):
    assert mapping.boundary_tokens("one, two 😀 three", 5, 8) == (",", "😀") and mapping.boundary_tokens("x", 0, 1) == ("", "")
    df = spark.createDataFrame([("1.", "1."), (None, "a."), ("(1)", None), ("1.", "2.")], "a string, b string")
    assert [r[0] and tuple(r[0]) for r in df.select(mapping.label_change(F.col("a"), F.col("b"))).collect()] == [None, ("insert", "", "a."), ("original", "(1)", ""), ("original", "1.", "2.")]
    said = spark.createDataFrame([("renumbered", "A {1}", "B"), ("row moved", None, None)], "code string, old string, new string")
    assert [r[0] for r in said.select(mapping.message("de")).collect()] == ["Neu nummeriert: A {1} -> B", "Tabellenzeile verschoben"]
    lines = spark.createDataFrame([(1, 0, 0, 5), (1, 1, 5, 9)], "d int, line_no int, start int, end int")
    marks = spark.createDataFrame([(1, "delete", 3, 7)], "d int, kind string, start int, end int")
    assert sorted(map(tuple, mapping.clipped(lines, marks, ("d",)).collect())) == [(1, 0, "delete", 3, 5), (1, 1, "delete", 0, 2)]
    rows = spark.createDataFrame([("c", 1, "the  fee"), ("c", 2, "a fee and the fee"), ("c", 3, "none")], "comparison_id string, row_id int, text string")
    anchors = spark.createDataFrame([("c", "the fee"), ("c", "TheFee"), ("c", "zzz")], "comparison_id string, anchor string")
    assert {r.anchor: r.row_id for r in mapping.anchored(anchors, rows).collect()} == {"the fee": 2, "TheFee": 1, "zzz": None}
    units = spark.createDataFrame([(1, "article"), (1, "cell"), (2, "block")], "doc_id int, kind string")
    assert {r.doc_id: (r.n_units, r.n_article, r.n_cell) for r in mapping.units_of_documents(units).collect()} == {1: (2, 1, 1), 2: (1, 0, 0)}
    assert [r.id for r in mapping.page(spark.range(10), ("id",), 1, 4).collect()] == [4, 5, 6, 7]
    assert [r[0] for r in spark.createDataFrame([("x" * 200 + "\ny",)], "t string").select(mapping.excerpt_text(F.col("t"))).collect()] == ["x" * 159 + "…"]
    from textloom.__main__ import file_lines

    assert file_lines("a\nb\n", "a\nc\n") == ["replace 2,2 2,2", "- b", "+ c"]


RUST = '''/* a /* nested fn x() {} */ fn y() {} */
pub(crate) async unsafe extern "C" fn top<T: Into<String>>(a: &'a str) -> Result<Vec<T>, E> where T: X { let s = r#"fn no() { "#; let c = '}'; fn nested() {} }
#[derive(Debug)]
pub struct A(pub i32, String);
pub enum E { X { a: i32 }, Y = 3 }
pub trait T: Clone { fn sig(&self); fn dflt(&self) -> i32 { 1 } type Item; const N: usize; }
impl<'a, K: Ord> T for A<K> where K: Copy { type Item = u8; const N: usize = { 3 }; fn sig(&self) { println!("fn zz() {{}}"); } }
macro_rules! m { ($n:ident) => { fn made() {} } }
mod m1 { mod m2; pub fn f() -> impl Fn(i32) -> i32 { move |x| x } }
'''
SHARP = '''namespace N.M;
#region x {
[Attr("]")] public partial class C<T> : B, I<T> where T : new() {
  private readonly int x = Foo(3);
  public C(int a) : base(a) { x = a; }
  ~C() { }
  [Fact] public async Task<List<int>> Go<U>(int a, string s = "}") where U : class { void Local() { } var q = $"{x["a"]} {{ }} {(a > 1 ? "y" : "n")}"; return Do(3); }
  string Name() => $@"x ""{1}""";
  public int P { get; set; } = F(1);
  public int this[int i] { get { return 1; } }
  public static C operator +(C a, C b) { return a; }
  public delegate void D(int a);
  (int, string) Tup() { return (1, """raw " { string """); }
  enum K { A, B = 2 }
}
public record R(int A, string B);
interface I { void Foo(); int Bar() => 2; }
'''


def test_declaration_kinds():
    got = symbols.declarations(RUST, "rust")
    assert [(k, s, n) for k, s, n, *_ in got] == [
        ("function", "", "top"), ("function", "", "nested"), ("struct", "", "A"), ("enum", "", "E"), ("trait", "", "T"), ("function", "trait:T", "dflt"), ("const", "trait:T", "N"),
        ("type", "impl:A<K>", "Item"), ("const", "impl:A<K>", "N"), ("function", "impl:A<K>", "sig"), ("function", "mod:m1", "f"),
    ]
    assert all(RUST.encode()[a:b].decode() == src for *_, src, a, b in got) and got[2][4] == "(pub i32, String)" and got[8][3] == ""
    got = symbols.declarations(SHARP, "csharp")
    assert [(k, s, n) for k, s, n, *_ in got] == [
        ("class", "namespace:N.M", "C"), ("constructor", "namespace:N.M/class:C", "C"), ("method", "namespace:N.M/class:C", "Go"), ("method", "namespace:N.M/class:C", "Name"),
        ("method", "namespace:N.M/class:C", "Tup"), ("enum", "namespace:N.M/class:C", "K"), ("record", "namespace:N.M", "R"), ("interface", "namespace:N.M", "I"),
        ("method", "namespace:N.M/interface:I", "Foo"), ("method", "namespace:N.M/interface:I", "Bar"),
    ]
    assert all(SHARP.encode()[a:b].decode() == src for *_, src, a, b in got)
    assert symbols.declarations("fn a() {", "rust") is None and symbols.declarations("x", "go") is None and symbols.declarations("", "rust") == []
    assert symbols.declarations("class A { int x => 1", "csharp") is None


@pytest.mark.parametrize("language", ["rust", "csharp"])
def test_masks_keep_places(language):
    for text in (RUST, SHARP, '"open', "/* open", "'", '$"{', 'r#"', "a'b'c"):
        masked = symbols._masked(text, language)
        assert len(masked) == len(text) and masked.count("\n") == text.count("\n")


def test_dice_pairs_find_all(spark):
    """Rare tokens first: the same pairs as all pairs give."""
    import random

    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    base = [[rng.choice(words) for _ in range(30)] for _ in range(6)]
    side = lambda n: [(f"{n}{i}", " ".join(rng.choice(words) if rng.random() < 0.03 else w for w in base[i % 6])) for i in range(18)]
    left, right = side("a"), side("b")
    frames = [spark.createDataFrame([(k, "g", t) for k, t in rows], f"{n} string, g string, body string") for rows, n in ((left, "x"), (right, "y"))]
    got = {(r.x, r.y): r.permille for r in ledger.dice_pairs(*frames, ("g",), "x", "y", least=880, tokens=12, distinct=8).collect()}
    from collections import Counter

    want = {}
    for x, a in left:
        for y, b in right:
            p, q = Counter(a.split()), Counter(b.split())
            permille = 2000 * sum((p & q).values()) // (sum(p.values()) + sum(q.values()))
            if permille >= 880 and len(p) >= 8:
                want[x, y] = permille
    assert got == want and want


def _dice(left, right, least, tokens, distinct):
    """Every pair (x, y) of two lists (group, key, text) at `least`; the texts of one key are one bag."""
    from collections import Counter, defaultdict

    sides = defaultdict(Counter), defaultdict(Counter)
    for bags, rows in zip(sides, (left, right)):
        for g, k, t in rows:
            if None not in (g, k, t):
                bags[g, k].update(t.split())
    out = {}
    for (g, x), p in sides[0].items():
        for (h, y), q in sides[1].items():
            n, m = sum(p.values()), sum(q.values())
            if g == h and n >= tokens and m >= tokens and len(p) >= distinct and 2000 * sum((p & q).values()) // (n + m) >= least:
                out[g, x, y] = 2000 * sum((p & q).values()) // (n + m)
    return out


def test_dice_pairs_of_copies_and_odd_rows(spark, monkeypatch):
    """Large groups in tiles, an order learned from few texts, ids too many to send, repeated and null keys."""
    import random

    from textloom.operators import bags

    for name, n in (("SAMPLE", 20), ("NAMED", 30), ("SENT", 0), ("TILE", 3), ("BLOCK", 5)):
        monkeypatch.setattr(bags, name, n)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(80)]
    base = [[rng.choice(words[: 80 - 20 * (i % 2)]) for _ in range(14 + 6 * i)] for i in range(8)]
    side = lambda: [(f"g{i % 2}", i, " ".join(rng.choice(words) if rng.random() < 0.04 * (i % 3) else w for w in base[i % 8])) for i in range(64)]
    long = " ".join(rng.choice(words) for _ in range(9000))
    odd = [("g0", 900, None), (None, 901, "a " * 20), ("g0", None, "a " * 20), ("g0", 902, "a " * 20), ("g1", 903, ""), ("g1", 904, long), ("g1", 905, long + " " + "w1 " * 400), ("g0", 906, "a b c d e f g"), ("g0", 906, "h i j k l m"), ("g0", 907, "a b c d e f g h i j k l m")]
    left, right = side() + odd, side() + odd
    frames = [spark.createDataFrame(rows, f"id string, {n} {kind}, body string") for rows, n, kind in ((left, "x", "int"), (right, "y", "long"))]
    for least in (880, 600):
        got = ledger.dice_pairs(*frames, ("id",), "x", "y", least=least)
        assert got.dtypes == [("id", "string"), ("x", "int"), ("y", "bigint"), ("permille", "int")]
        want = _dice(left, right, least, 12, 8)
        rows = [tuple(r) for r in got.collect()]
        assert len(rows) == len(want) and {r[:3]: r[3] for r in rows} == want
        assert want["g0", 906, 907] == 1000 and ("g1", 904, 905) in want


def test_like_classes_of_hot_uses(spark, monkeypatch):
    """Classes and links against all pairs, with uses dealt in tiles, copies, repeated keys, nulls, short texts."""
    import random

    from textloom.functions.text import code_tokens
    from textloom.operators import bags

    for name, n in (("USE_TILE", 3), ("TILE", 3), ("BLOCK", 9)):
        monkeypatch.setattr(bags, name, n)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    base = [rng.choice(words) for _ in range(30)]
    rows = [("a" if i % 3 else "b", i, " ".join(rng.choice(words) if rng.random() < 0.03 * (i % 5) else w for w in base)) for i in range(90)]
    rows += [("a", 200 + i, rows[1][2]) for i in range(60)] + [("a", 300, None), (None, 301, rows[1][2]), ("a", None, rows[1][2]), ("a", 302, ""), ("a", 303, "a " * 50), ("a", 304, "few words"), ("b", 305, "a b c d e f g"), ("b", 305, "h i j k l m n")]
    df = spark.createDataFrame(rows, "g string, id int, t string")
    got = {(r.g, r.id): (r.class_id, r.n_links, r.permille) for r in bags.like_classes(df, ("g",), "id", "t", code_tokens, 900, 12, 8).collect()}
    texts = {}
    for g, i, t in rows:
        if None not in (g, i, t):
            texts[g, i] = texts.get((g, i), "") + " " + t
    bag = {k: Counter(t.split()) for k, t in texts.items()}
    fit = {k: b for k, b in bag.items() if sum(b.values()) >= 12 and len(b) >= 8}
    first = {k: min(i for (g, i), b in fit.items() if g == k[0] and b == fit[k]) for k in fit}
    want = {k: (None, 0, None) for k in bag}
    for k, c in first.items():
        links = {}
        for (g, j), d in first.items():
            if g == k[0] and j == d != c:
                score = 2000 * sum((fit[g, c] & fit[g, j]).values()) // (sum(fit[g, c].values()) + sum(fit[g, j].values()))
                if score >= 900:
                    links[j] = score
        want[k] = (c, len(links), max(links.values(), default=None))
    assert got == want and max(x[1] for x in want.values()) > 10
    assert bags.like_classes(df.limit(0), ("g",), "id", "t", code_tokens, 900, 12, 8).count() == 0


def test_near_documents_of_short_texts(spark, tmp_path):
    """Every document has a row, and no text is too short for a class or a link; the SQL agrees."""
    import duckdb

    from textloom.plans import registry

    ten = "a b c d e f g h i j"
    texts = [("en", 1, "x y"), ("en", 2, "y x"), ("en", 3, ten), ("en", 4, ten[:-1] + "k"), ("de", 5, ten), ("en", 6, None), ("en", 7, " "), (None, 8, ten), (None, 8, ten), ("en", None, ten)]
    texts += [("en", 10, "p q r s t u v " * 3), ("en", 11, "p q r s t u v " * 3 + "w"), ("en", 12, "one")]
    spark.createDataFrame(texts, "lang string, doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in registry.near_documents(spark, str(tmp_path)).collect()]
    assert {r[:2]: r[2:] for r in got} == {
        ("en", 1): (1, 0, None), ("en", 2): (1, 0, None), ("en", 3): (3, 1, 900), ("en", 4): (4, 1, 900), ("de", 5): (5, 0, None), ("en", 6): (None, 0, None), ("en", 7): (None, 0, None),
        (None, 8): (None, 0, None), ("en", None): (None, 0, None), ("en", 10): (10, 1, 976), ("en", 11): (11, 1, 976), ("en", 12): (12, 0, None),
    }
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(got, key=str) == sorted(con.sql(registry.ORACLE_SQL["near_documents"]).fetchall(), key=str)


def test_bags_of_a_tile_are_looked_up_together(monkeypatch):
    """Each pair's permille is right, some bags at a time or all, and no pair is searched by itself."""
    import random

    import numpy as np

    from textloom.operators import bags

    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(60)]
    texts = [[w for w in base for _ in range(rng.choice([0, 1, 1, 1, 300]))] or base[:1] for _ in range(50)] + [base[:1], base]
    counts, ids = [Counter(x) for x in texts], [7 * i + 3 for i in range(len(texts))][::-1]
    packed = [bags._packed(*np.unique(np.array(x, np.uint64), return_counts=True)) for x in texts]
    score = lambda i, j: 2000 * sum((counts[i] & counts[j]).values()) // (len(texts[i]) + len(texts[j]))
    pairs = sorted(((ids[i], ids[j], score(i, j)) for i in range(len(texts)) for j in range(len(texts)) if ids[i] < ids[j]), key=lambda p: p[1::-1])
    want = [p for p in pairs if p[2] >= 400]
    assert 20 < len(want) < len(pairs)
    searched, search = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda *a, **k: (searched.append(1), search(*a, **k))[1])
    for looked in (1, 150, 10**6):
        monkeypatch.setattr(bags, "LOOKED", looked, raising=False)
        made = bags._Bags(np.array(ids), packed, 400)
        got = made(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
        assert list(zip(*(c.tolist() for c in got))) == want
    assert len(searched) < len(pairs) / 10


def test_candidates_go_in_parts(monkeypatch):
    """Candidates are dealt as parts of tiles, not a row each; those that met often come out once if the sketches let them."""
    import random

    import numpy as np
    import pyarrow as pa

    from textloom.operators import bags

    rng = random.Random(4)
    ids = [5 * i + (i % 3 << 33) for i in range(60)]
    met = [tuple(sorted(rng.sample(ids, 2))) for _ in range(3_000)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*met[i : i + 500])], ["a", "b"]) for i in range(0, 3_000, 500)]
    monkeypatch.setattr(bags, "PARTS", 2, raising=False)
    rows = pa.Table.from_batches(bags._paired(iter, 3)(iter(batches))).to_pylist()
    assert len(rows) <= 6 * 6 * 2  # of each batch one for each of the six pairs of three blocks and each part
    dealt = [p for r in rows for p in zip(*np.frombuffer(r["value"], np.int64).reshape(2, -1).tolist())]
    assert sorted(dealt) == sorted(met) and all(r["tile"] == min(a % 3, b % 3) * 3 + max(a % 3, b % 3) for r in rows for a, b in zip(*np.frombuffer(r["value"], np.int64).reshape(2, -1).tolist()))
    sketch = {i: (20).to_bytes(4, "little") + bytes([20 if k == i % 4 else 0 for k in range(8)]) for i in ids}
    tiles = sorted({r["tile"] for r in rows})
    rows += [{"tile": k, "part": -1, "id": i, "value": sketch[i]} for k in tiles for i in ids if i % 3 in (k // 3, k % 3)]
    rows.sort(key=lambda r: (r["tile"], r["part"]))
    for step in (1, 7, 1_000):
        got = [tuple(p.values()) for b in bags._likely(0.9)(iter(pa.RecordBatch.from_pylist(rows[i : i + step], schema=pa.schema([("tile", pa.int64()), ("part", pa.int64()), ("id", pa.int64()), ("value", pa.binary())])) for i in range(0, len(rows), step))) for p in b.to_pylist()]
        assert sorted(got) == sorted({(a, b) for a, b in met if a % 4 == b % 4}) and len(got) > 100


def test_meetings_across_batches(monkeypatch):
    """Sorted uses that come in any batches, with few pairs held, meet as in one."""
    import random

    import pyarrow as pa

    from textloom.operators import bags

    rng = random.Random(3)
    rows = sorted((rng.randrange(4), (rng.randrange(20, 40) << 32) | (rng.randrange(1, 9) << 2) | rng.randrange(1, 4), rng.randrange(3), i) for i in range(300))
    t, share = 0.8, 0.8 / 1.2
    want = set()
    for i, (e, at, before, x) in enumerate(rows):
        for f, to, prior, y in rows[i + 1 :]:
            s, r, p, q = at >> 32, to >> 32, (at >> 2) & 63, (to >> 2) & 63
            sides = (at & 1 and to & 2) or (at & 2 and to & 1)
            if e == f and sides and r <= s / share + 1e-6 and 1 + min(s - p, r - q) >= t / 2 * (s + r) - 1e-6 and (before != prior or not before):
                want.add((min(x, y), max(x, y)))
    for swept, held, step in ((10**6, 10**6, 300), (7, 5, 3), (1, 1, 1), (50, 20, 11)):
        monkeypatch.setattr(bags, "SWEPT", swept)
        monkeypatch.setattr(bags, "HELD", held)
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + step])], ["use", "at", "before", "id"]) for i in range(0, 300, step)]
        got = [tuple(r.values()) for b in bags._meetings(t, share)(iter(batches)) for r in b.to_pylist()]
        assert want and set(got) == want and len(got) == len(set(got))


def test_dice_pairs_move_little(spark):
    """Texts that are not alike are not dealt token by token: less than twice their own bytes is shuffled."""
    import random

    rng = random.Random(4)
    side = lambda n: spark.createDataFrame([("g", f"{n}{i}", " ".join(f"word{int(rng.paretovariate(0.4)) % 50_000}" for _ in range(400))) for i in range(200)], f"g string, {n} string, body string")
    left, right = side("x"), side("y")
    size = sum(len(r.body) for d in (left, right) for r in d.collect())
    sc = spark.sparkContext

    def written():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(i) for i in range(stages.size()))}

    before = written()
    ledger.dice_pairs(left, right, ("g",), "x", "y").collect()
    assert sum(n for k, n in written().items() if k not in before) < 2 * size
