"""Declarations as relations of tokens, against the scanner and planted errors."""

import pytest

from test_compare import RUST, SHARP
from textloom.operators import grammar, symbols

MORE_RUST = """#![allow(x)]
extern "C" { fn foreign(a: i32); }
pub const fn k() -> i32 { let x = 1.; let v = [0; 3]; f(1, 2,); m!(= ; ,,); if a < b { 1 } else { 2 } }
impl<T: Fn(i32) -> Vec<u8>> Show for Box<T> where T: Clone { fn show(&self) { match self { A if 1 == 2 => {}, _ => () } } }
pub(super) enum Emp {}
struct Unit;
pub(crate) struct Pair(pub(crate) i32, u8);
type Alias<'a> = &'a str;
const _: () = { fn hidden() {} };
"""
MORE_SHARP = """using System;
namespace A.B { namespace C { public sealed record P(int X) { public P() : this(1) { } record Q(int Y); record struct R(int Z) { int Sum() => Z + 1; } }
  static class E { public static T First<T>(this IList<T> xs) where T : class => xs is { Count: > 0 } ? xs[0] : null; int[,] Grid(int[,] a) { for (;;) { } } void IFoo.Bar() { } bool Is(object o) => o is 1 or 2; event Action Done; }
} }
interface IEmpty { }
struct S { [Obsolete("x")] public S(int a) { } int f = Make(1); string T() { return $"{(a ? "}" : "{")}" + @"\\"; } }
"""
BROKEN = [
    ("cs", "class C { void M() { int x = ; } }"), ("cs", "class C { void M() { f(1, ); } }"), ("cs", "class { }"), ("cs", "class C { void M( { } }"), ("cs", "class C { string s = \"open; }"), ("cs", "class C { int x = 1 y; }"),
    ("rs", "fn a() { let x = ; }"), ("rs", "fn a() { let x = 1 let y = 2; }"), ("rs", "struct { a: i32 }"), ("rs", "fn (a: i32) -> { }"), ("rs", "fn a() { f(, 1); }"), ("rs", "fn a() { /* open }"), ("rs", "fn a() { (1] }"), ("rs", "fn a() {} }"), ("rs", "fn a() { b.c(1,,2) }"), ("rs", None),
]


def files(spark, rows):
    return spark.createDataFrame([(f"{i}.{ext}", text, "x", "y") for i, (ext, text) in enumerate(rows)], "path string, content string, language string, cid string")


def test_declarations_are_the_scanner_s(spark):
    texts = [("rs", RUST), ("cs", SHARP), ("rs", MORE_RUST), ("cs", MORE_SHARP), ("rs", ""), ("cs", "\n"), ("rs", RUST)]
    found, told = symbols.parse_symbols(files(spark, texts))
    assert all(r.supported for r in told.collect()) and told.count() == len(texts)
    got = {}
    for r in found.orderBy("path", "byte_start").collect():
        got.setdefault(r.path, []).append((r.kind, r.scope, r.name, r.signature, r.body, r.source, r.byte_start, r.byte_end))
    for i, (ext, text) in enumerate(texts):
        assert got.get(f"{i}.{ext}", []) == symbols.declarations(text, symbols.LANGUAGES[ext])
    assert {k for i in (0, 2) for k, *_ in got[f"{i}.rs"]} == {"function", "struct", "enum", "trait", "type", "const"}
    assert {k for i in (1, 3) for k, *_ in got[f"{i}.cs"]} == {"class", "struct", "interface", "enum", "record", "method", "constructor"}


def test_records_make_no_methods(spark):
    found, _ = symbols.parse_symbols(files(spark, [("cs", "class C { record P(int A); record struct Q(int B) { } }")]))
    assert sorted((r.kind, r.scope, r.name) for r in found.collect()) == [("class", "", "C"), ("record", "class:C", "P"), ("record", "class:C", "Q")]


def test_wrong_syntax_is_refused(spark):
    found, told = symbols.parse_symbols(files(spark, BROKEN))
    assert {r.path for r in told.where("supported").collect()} == set() and found.count() == 0


def test_limits_and_long_tokens(spark, monkeypatch):
    long = "/*" + "* x" * 50_000 + "*/ fn a() { let s = \"" + "x\\n" * 60_000 + "\"; }"
    deep = "fn a() { " + "(" * 200 + ")" * 200 + " }"
    many = "fn a() {}\n" * 60
    monkeypatch.setattr(grammar, "MOST_SYMBOLS", 50)
    found, told = symbols.parse_symbols(files(spark, [("rs", long), ("rs", deep), ("rs", many), ("txt", "x"), ("rs", "/*" * 20_000), ("cs", "/*" * 20_000)]))
    assert {r.path: r.supported for r in told.collect()} == {"0.rs": True, "1.rs": False, "2.rs": False, "4.rs": False, "5.cs": False}
    assert [(r.path, r.name) for r in found.collect()] == [("0.rs", "a")]
    none = files(spark, [("rs", "")]).limit(0)
    assert [x.count() for x in symbols.parse_symbols(none)] == [0, 0]


if __name__ == "__main__":
    pytest.main([__file__])


def test_contents_get_tasks_by_bytes(spark, monkeypatch):
    """More text is dealt over more tasks, so that the sorts of one task don't grow with it."""
    from textloom.operators import grammar

    dealt, write = [], grammar.saved
    monkeypatch.setattr(grammar, "TASK_BYTES", 100)
    monkeypatch.setattr(grammar, "saved", lambda df: (dealt.append(df.rdd.getNumPartitions()), write(df))[1])
    rows = [(f"c{i}", "rust", f"fn name_{i:03}() {{ }}") for i in range(50)]  # 17 bytes each
    symbols, _ = grammar.declared(spark.createDataFrame(rows, "cid string, language string, text string"))
    assert sorted(r["name"] for r in symbols.collect()) == [f"name_{i:03}" for i in range(50)] and dealt[0] == 9


def test_what_cannot_follow_is_told_with_the_brackets(spark):
    rows = [(1, "a", "rust", "const A: i32 = 1;"), (2, "b", "rust", "const A: i32 = ;"), (3, "c", "rust", "fn f() { m!(a b = ;) }")]
    found = grammar._bracketed(grammar._tokens(spark.createDataFrame(rows, "k long, cid string, language string, text string")))
    assert {r.cid for r in found.where("bad").select("cid").collect()} == {"b"}


def test_tokens_are_no_rows(spark, monkeypatch):
    """Brackets and segments are found where a content lies: no token is shuffled or sorted, and calls of any size agree."""
    texts = [("c%d" % i, symbols.LANGUAGES[ext], text) for i, (ext, text) in enumerate([("rs", MORE_RUST), ("cs", MORE_SHARP), ("rs", ""), *[x for x in BROKEN if x[1]], ("rs", RUST), ("cs", SHARP)])]
    df = spark.createDataFrame([(1, *r) for r in texts], "k long, cid string, language string, text string")
    found = grammar._bracketed(grammar._tokens(df))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "Window" not in plan
    rows = sorted(found.collect())
    monkeypatch.setattr(grammar, "CALL_TOKENS", 1)
    assert rows == sorted(grammar._bracketed(grammar._tokens(df)).collect())
    assert {r.cid for r in rows if r.bad} == {f"c{i}" for i in range(3, 3 + len(BROKEN) - 1)}
    open_ = grammar._bracketed(grammar._tokens(spark.createDataFrame([(1, "a", "rust", "/* /* */\n")], df.schema)))
    assert [r.bad for r in open_.collect()] == [True]  # a comment that does not end is none
