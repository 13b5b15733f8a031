"""Named queries over the test tables and their SQL.

Files, versions and pairs are read from the tables as they are: a source of
`documents` is a snapshot whose files are its documents by position, the next
source by code point is the snapshot after it, and neighbouring turns of a
conversation are the two versions of a text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import similarity, text
from ..operators import align, bags, compare, diff, ledger, mapping, review, structure, symbols
from ..sources.decode import decode_col
from ..sources.package import paragraph_context as context_of
from ..storage import dealt, saved, spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _snapshots(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(before, after) trees keyed by cmp, the rank of the earlier source."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("source"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), F.octet_length("text").alias("length"))
    rank = docs.select("source").distinct().withColumn("cmp", F.dense_rank().over(Window.orderBy("source")))
    path = F.format_string("f%06d.txt", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")))
    files = docs.withColumn("path", path).join(rank, "source").select("cmp", "path", "sha", "length")
    return files, files.withColumn("cmp", F.col("cmp") - 1).where("cmp > 0").select("cmp", "path", "sha", "length")


def _ledger(spark, sf_dir):
    before, after = _snapshots(spark, sf_dir)
    return ledger.file_ledger(before.join(after.select("cmp").distinct(), "cmp", "left_semi"), after, ("cmp",))


_SNAP = """
WITH s AS (SELECT doc_id, source, sha256(coalesce(text, '')) AS sha FROM documents),
k AS (SELECT source, dense_rank() OVER (ORDER BY source) AS cmp FROM (SELECT DISTINCT source FROM s)),
f AS (SELECT cmp, printf('f%06d.txt', row_number() OVER (PARTITION BY s.source ORDER BY doc_id)) AS path, sha FROM s JOIN k USING (source)),
b AS (SELECT * FROM f WHERE cmp < (SELECT max(cmp) FROM f)),
a AS (SELECT cmp - 1 AS cmp, path, sha FROM f WHERE cmp > 1),
j AS (SELECT cmp, path, b.sha AS bs, a.sha AS s2 FROM b FULL JOIN a USING (cmp, path)),
g AS (SELECT *, count(*) OVER (PARTITION BY cmp, bs) AS n FROM j WHERE s2 IS NULL),
w AS (SELECT *, count(*) OVER (PARTITION BY cmp, s2) AS n FROM j WHERE bs IS NULL),
r AS (SELECT g.cmp, g.path AS bp, w.path AS ap, g.bs AS sha FROM g JOIN w ON g.cmp = w.cmp AND g.bs = w.s2 AND g.n = 1 AND w.n = 1),
l AS (
  SELECT cmp, 'modified' AS kind, path AS before_path, path AS after_path, bs AS before_sha, s2 AS after_sha FROM j WHERE bs <> s2
  UNION ALL SELECT cmp, 'renamed', bp, ap, sha, sha FROM r
  UNION ALL SELECT cmp, 'deleted', path, NULL, bs, NULL FROM g WHERE (cmp, path) NOT IN (SELECT (cmp, bp) FROM r)
  UNION ALL SELECT cmp, 'added', NULL, path, NULL, s2 FROM w WHERE (cmp, path) NOT IN (SELECT (cmp, ap) FROM r))
"""


def file_ledger(spark, sf_dir):
    return _ledger(spark, sf_dir).withColumn("cmp", F.col("cmp").cast("long"))


def changes_by_kind(spark, sf_dir):
    return ledger.changes_by_kind(_ledger(spark, sf_dir), ("cmp",)).withColumn("cmp", F.col("cmp").cast("long"))


def file_events(spark, sf_dir):
    e = review.change_events(_ledger(spark, sf_dir).withColumn("cmp", F.col("cmp").cast("long")), ("cmp",))
    return e.select("cmp", "kind", F.col("before.path").alias("before_path"), F.col("after.path").alias("after_path"), "description", "evidence", "event_id")


def document_copies_ledger(spark, sf_dir):
    """Documents as files named by id against their texts' first copies."""
    docs = _table(spark, sf_dir, "documents").select(F.col("lang").alias("lang"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("content"))
    snap = ledger.snapshot(docs, keys=("lang",))
    return snap.groupBy("lang", "sha").agg(F.count("*").alias("copies"), F.min("path").alias("first_path"), F.max("length").cast("long").alias("length"))


def _turns(spark, sf_dir) -> DataFrame:
    """(conv_id, turn, old, new): each turn and the next one of its conversation."""
    t = spread(_table(spark, sf_dir, "conversations"), "conv_id")
    nxt = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.withColumn("new", nxt).where(F.col("new").isNotNull()).select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("old"), "new")


_TURNS = "WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS old, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS new FROM conversations), p AS (SELECT * FROM t WHERE new IS NOT NULL)\n"


def line_hunks(spark, sf_dir):
    h = diff.diff_lines(_turns(spark, sf_dir), "old", "new", ("conv_id", "turn"))
    return h.select("conv_id", "turn", "kind", *[F.col(c).cast("long").alias(c) for c in ("ord", "before_start", "before_end", "after_start", "after_end")], "limited")


def document_hunks(spark, sf_dir):
    """Every document against the one before it of its source, by lines cut to
    three characters, so that lines repeat."""
    cut = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?m)^(.{0,3}).*$", "$1")
    d = spread(_table(spark, sf_dir, "documents").select("doc_id", "source", cut.alias("new")), "source")
    pairs = d.withColumn("old", F.lag("new").over(Window.partitionBy("source").orderBy("doc_id"))).where("old IS NOT NULL")
    return diff.diff_lines(pairs, "old", "new", ("doc_id",)).select("doc_id", "kind", *[F.col(c).cast("long").alias(c) for c in ("ord", "before_start", "before_end", "after_start", "after_end")])


def review_events(spark, sf_dir):
    return review.compare_pairs(_turns(spark, sf_dir), ("conv_id", "turn"))


def set_similarity(spark, sf_dir):
    p = _turns(spark, sf_dir).withColumns({"a": text.word_set(F.col("old")), "b": text.word_set(F.col("new"))})
    return p.select("conv_id", "turn", F.size("a").cast("long").alias("n_old"), F.size("b").cast("long").alias("n_new"), F.round(similarity.jaccard(F.col("a"), F.col("b")), 9).alias("jaccard"), F.round(similarity.containment(F.col("a"), F.col("b")), 9).alias("containment"))


def text_similarity(spark, sf_dir):
    a, b = F.col("old"), F.col("new")
    return _turns(spark, sf_dir).select("conv_id", "turn", similarity.indel_ratio_col(a, b).alias("indel"), similarity.sequence_ratio_col(a, b).alias("sequence"), similarity.token_similarity_col(a, b).alias("token"))


def body_dice(spark, sf_dir):
    p = _turns(spark, sf_dir).withColumn("pid", F.concat_ws("/", "conv_id", "turn"))
    left, right = p.select("pid", F.lit("a").alias("x"), F.col("old").alias("body")), p.select("pid", F.lit("b").alias("y"), F.col("new").alias("body"))
    return ledger.dice_pairs(left, right, ("pid",), "x", "y", least=0).select("pid", F.col("permille").cast("long").alias("permille"))


def code_lines(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(text.code_lines(F.coalesce("text", F.lit("")))).cast("long").alias("n_lines"), text.content_id(F.col("text")).alias("content_id"))


def line_offsets(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    out = review.line_offsets(d, ("doc_id",))
    return out.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("line_no", "byte_start", "byte_end", "utf16_start", "utf16_end")])


def text_keys(spark, sf_dir):
    t = F.col("text")
    d = _table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(text.compact(t), 256).alias("compact"), F.sha2(text.trim_edges(t), 256).alias("trimmed"), F.sha2(text.collapse_spaces(t), 256).alias("collapsed"), text.punctuation_only(t).alias("punctuation"), text.structure_signature(t)["numbers"].cast("long").alias("numbers"), structure.looks_legal(t).alias("legal"))


def unicode_keys(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    return d.select("doc_id", text.match_key_col("text").alias("match_key"), text.visible_key_col("text").alias("visible_key"), text.lineage_key_col("text").alias("lineage_key"))


def decoded_texts(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(decode_col(F.encode("text", "UTF-16LE")), 256).alias("utf16_id"), F.sha2(decode_col(F.encode("text", "UTF-8")), 256).alias("utf8_id"))


def url_paths(spark, sf_dir):
    p = F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1)
    d = _table(spark, sf_dir, "pages").select("page_id", p.alias("p"))
    return d.select("page_id", text.extension(F.col("p")).alias("extension"), text.supported_file(F.col("p")).alias("supported"), text.safe_relative_path(F.col("p")).alias("safe"))


def xml_escaped(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.sha2(text.xml_text(F.col("html")), 256).alias("xml_id"))


def row_heights(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", review.row_height(F.col("text"), 40, F.col("role") == "system").cast("long").alias("height"))


def search_rows(spark, sf_dir):
    return review.search(_table(spark, sf_dir, "documents"), "The  of").select("doc_id")


def section_labels(spark, sf_dir):
    t = _table(spark, sf_dir, "conversations").withColumn("section", F.col("role"))
    return review.section_labels(t, ("conv_id",), "turn").select("conv_id", "turn", "section_label")


def moved_rows(spark, sf_dir):
    o = dealt(_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate"), "l_orderkey")
    new = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey"))
    old = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_shipdate", "l_partkey"))
    m = o.withColumns({"old_ix": old, "new_ix": new})
    return review.moved_rows(m, ("l_orderkey",)).select("l_orderkey", F.col("old_ix").cast("long").alias("old_ix"), F.col("new_ix").cast("long").alias("new_ix"), "crossed")


def vote_map(spark, sf_dir):
    o = _table(spark, sf_dir, "lineitem").select("l_returnflag", "l_partkey", "l_suppkey")
    return align.vote_map(o, ("l_returnflag",), "l_partkey", "l_suppkey")


def nth_occurrence(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("text", "doc_id", "source")
    half = F.substring("source", 4, 3).cast("int") < 10
    return align.nth_occurrence_join(d.where(half).drop("source"), d.where(~half).drop("source"), "text", "doc_id").select("doc_id", "doc_id_right", F.col("nth").cast("long").alias("nth"))


def missing_blobs(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").withColumn("content", F.col("text"))
    stored = ledger.missing_blobs(_table(spark, sf_dir, "benchmark").withColumn("content", F.col("text")), spark.createDataFrame([], "sha string"))
    return ledger.missing_blobs(docs, stored).select("sha", F.octet_length("content").cast("long").alias("length"))


def import_report(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.concat(F.substring("source", 1, 3), F.lit("/"), F.col("lang"), F.lit(".txt")).alias("path"), F.sha2("text", 256).alias("sha"))
    known = _table(spark, sf_dir, "benchmark").select(F.lit("src/en.txt").alias("path"), F.sha2("text", 256).alias("sha"))
    return ledger.import_report(docs, known)


def document_units(spark, sf_dir):
    return structure.parse_units(_table(spark, sf_dir, "documents"))


def list_parts(spark, sf_dir):
    units = _table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("unit_ix"), F.col("text").alias("body"))
    return structure.part_levels(structure.parse_parts(units)).drop("core")


def _versions(spark, sf_dir) -> DataFrame:
    """(doc_id, old, new): each document and a version of it whose every fifth line
    is gone, whose every seventh begins anew, and whose first line is last."""
    d = spread(_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("old")), "doc_id")
    lines = F.filter(F.transform(F.split("old", "\n"), lambda x, i: F.when(i % 5 == 4, F.lit(None).cast("string")).when(i % 7 == 3, F.concat(F.lit("Anew "), x)).otherwise(x)), lambda x: x.isNotNull())
    turned = F.concat(F.slice(lines, F.lit(2), F.greatest(F.lit(0), F.size(lines) - 1)), F.slice(lines, 1, 1))
    return d.withColumn("new", F.array_join(turned, "\n"))


def _version_units(spark, sf_dir) -> DataFrame:
    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("doc_ord"), structure.units_col(F.col(c), F.lit("auto")).alias("us")) for i, c in enumerate(("old", "new"))])).alias("s")
    return _versions(spark, sf_dir).select("doc_id", sides).select("doc_id", "s.doc_ord", F.posexplode("s.us").alias("unit_ix", "u")).select("doc_id", "doc_ord", "unit_ix", "u.*")


def unit_matches(spark, sf_dir):
    return align.match_units(_version_units(spark, sf_dir), ("doc_id",))


def paragraph_context(spark, sf_dir):
    t = context_of(_table(spark, sf_dir, "conversations"), ("conv_id",), "turn")
    joined = [F.sha2(F.concat_ws("|", c), 256).alias(c) for c in ("before", "after")]
    return t.select("conv_id", "turn", F.col("nth").cast("long").alias("nth"), *joined)


def marker_numbers(spark, sf_dir):
    """Lines of an order as markers, of which the open ones have no number yet."""
    o = dealt(_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus"), "l_orderkey")
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    m = o.withColumn("stable_ord", nth).withColumn("num", F.when(F.col("l_linestatus") == "F", F.col("l_linenumber")))
    return review.ensure_numbered(m, ("l_orderkey",)).select("l_orderkey", F.col("stable_ord").cast("long").alias("stable_ord"), F.col("num").cast("long").alias("num"))


def changed_turns(spark, sf_dir):
    t = _turns(spark, sf_dir)
    lost = t.where("old <> new").select("conv_id", "turn")
    return review.changed_rows(t, lost, ("conv_id", "turn")).select("conv_id", "turn", "n_markers", "changed")


def turn_moves(spark, sf_dir):
    """Pairs of roles that follow each other, by majority, in conversations."""
    t = _table(spark, sf_dir, "conversations")
    nxt = F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    pairs = t.select(F.lit("all").alias("scope"), "role", nxt.alias("next_role")).where("next_role IS NOT NULL")
    return align.vote_map(pairs, ("scope",), "role", "next_role").drop("scope")


def unmatched_units(spark, sf_dir):
    u = saved(_version_units(spark, sf_dir))
    return review.missing_units(u.where("doc_ord = 0"), align.match_units(u, ("doc_id",)), ("doc_id",), side="old")


def document_comparison(spark, sf_dir):
    """Each document with its version, units aligned, markers numbered."""
    return compare.compare_texts(_versions(spark, sf_dir), ("doc_id",))[1]


def page_rows(spark, sf_dir):
    return mapping.page(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ("o_orderkey",), 2)


def renumbered_lines(spark, sf_dir):
    m = _table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("comparison_id"), F.col("l_orderkey").alias("row_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("num"))
    out = mapping.renumbered(m.withColumn("line", F.col("num")))
    return out.select("comparison_id", "row_id", "line.l_linenumber", "line.l_partkey", F.col("num").cast("long").alias("num"))


def clipped_ranges(spark, sf_dir):
    """A range of 100 units in the middle of each document, by line."""
    d = _table(spark, sf_dir, "documents").where("text IS NOT NULL")
    lines = review.line_offsets(d.select("doc_id", F.col("text").alias("content")), ("doc_id",)).select("doc_id", "line_no", F.col("utf16_start").alias("start"), F.col("utf16_end").alias("end"))
    middle = F.floor(text.utf16_length(F.col("text")) / 2)
    marks = d.select("doc_id", F.lit("delete").alias("kind"), (middle - 50).alias("start"), (middle + 50).alias("end"))
    out = mapping.clipped(lines, marks, ("doc_id",))
    return out.select("doc_id", "kind", *[F.col(c).cast("long").alias(c) for c in ("line_no", "start", "end")])


def _table_pairs(spark, sf_dir) -> DataFrame:
    """Lines of an order as matched units: some prose, some cells of two tables."""
    o = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    old, new = (F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*cols)) for cols in (("l_linenumber", "l_shipdate", "l_partkey", "l_suppkey"), ("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")))
    m = o.withColumns({"old_ix": old.cast("long"), "new_ix": new.cast("long")})
    cell = F.col("l_partkey") % 3 > 0
    when = lambda c: F.when(cell, c.cast("long"))
    return m.select("l_orderkey", "old_ix", "new_ix", when(F.col("l_partkey") % 3).alias("old_table"), when(F.col("old_ix")).alias("old_row"), when(F.lit(0)).alias("old_col"), when(F.col("l_partkey") % 3).alias("new_table"), when(F.col("new_ix")).alias("new_row"), when(F.lit(0)).alias("new_col"))


def table_moves(spark, sf_dir):
    return mapping.table_moves(_table_pairs(spark, sf_dir), ("l_orderkey",))


def label_changes(spark, sf_dir):
    t = _table(spark, sf_dir, "conversations").withColumn("next_role", F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn")))
    return t.select("conv_id", "turn", mapping.label_change(F.col("role"), F.col("next_role")).alias("c")).select("conv_id", "turn", "c.*")


def excerpt_lines(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2(mapping.excerpt_text(F.col("text"), 40), 256).alias("excerpt_id"))


def concrete_messages(spark, sf_dir):
    """Lines of orders as messages: returned ones as status, the others as what changed."""
    m = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_returnflag") != "N", "status").otherwise("retitled").alias("code"), F.when(F.col("l_returnflag") == "R", "changed").otherwise("moved").alias("old"))
    return mapping.concrete_messages(m, ("l_orderkey",)).select("l_orderkey", "l_linenumber", "l_partkey", "code", "old")


def byte_lines(spark, sf_dir):
    """The line that the middle byte of each document is on."""
    d = _table(spark, sf_dir, "documents").where("text IS NOT NULL")
    lines = review.line_offsets(d.select("doc_id", F.col("text").alias("content")), ("doc_id",))
    points = d.select("doc_id", F.floor(F.octet_length("text") / 2).alias("byte"))
    return mapping.lines_of(points, lines, ("doc_id",)).select("doc_id", "byte", F.col("line_no").cast("long").alias("line_no"))


def hunk_excerpts(spark, sf_dir):
    """Lines of documents with the made-up hunk (three lines of every ten) that they are in."""
    d = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.code_lines(F.col("text"))).alias("line_no", "line")).select("doc_id", F.col("line_no").cast("long").alias("line_no"))
    hunks = d.where("line_no % 10 = 2").select("doc_id", F.floor(F.col("line_no") / 10).alias("ord"), F.col("line_no").alias("after_start"), (F.col("line_no") + 3).alias("after_end"))
    return mapping.excerpts(d, hunks, ("doc_id",))


def _sources(spark, sf_dir, version: int) -> DataFrame:
    """Two versions of a source file for each part, made from its columns."""
    p = _table(spark, sf_dir, "part")
    key, size, kind = F.col("p_partkey"), F.col("p_size"), F.col("p_partkey") % 5
    head = F.lit(chr(47) * 2 + " fn not_here() {}\nconst MARK: &str = \"struct No {}\";\n")
    name = F.when((kind == 1) & F.lit(version == 1), F.concat(F.lit("renamed_"), key)).otherwise(F.concat(F.lit("part_"), key))
    value = F.when((kind == 2) & F.lit(version == 1), size + 1).otherwise(size)
    body = F.concat(F.lit("pub fn "), name, F.lit("(n: i32) -> i32 { n * "), value, F.lit(" + "), key, F.lit(" }\n"))
    extra = F.when((kind == 3) & F.lit(version == 1), F.lit("")).otherwise(F.concat(F.lit("mod inner { pub struct Size_"), size, F.lit(" { a: i32 } }\n")))
    return p.select(F.format_string("p%d.rs", key).alias("path"), F.concat(head, body, extra).alias("content"))


def declared_symbols(spark, sf_dir):
    found, _ = symbols.parse_symbols(_sources(spark, sf_dir, 0))
    return found.select("path", "language", "kind", "scope", "name", F.col("byte_start").cast("long").alias("byte_start"))


def declared_kinds(spark, sf_dir):
    """Declarations of a Rust and a C# source for each part, of all kinds of both
    languages; every tenth source has a syntax error and declares nothing."""
    p = _table(spark, sf_dir, "part")
    key, size, wrong = F.col("p_partkey"), F.col("p_size"), F.col("p_partkey") % 10 == 7
    value = F.when(wrong, "").otherwise(size.cast("string"))
    rust = F.format_string("use a::{b, c};\npub trait Priced%1$d { fn price(&self) -> i32 { 1 } fn sign(&self); }\npub enum Brand%1$d { A, B(u8) }\ntype Alias%1$d = Vec<i32>;\nconst SIZE: i32 = %2$s;\nstruct Part(i32);\nimpl<T> Priced%1$d for Brand%1$d where T: Copy { fn price(&self) -> i32 { match self { Self::A => %3$d, _ => 0 } } }\n", key, value, size)
    sharp = F.format_string("using System;\nnamespace Shop%1$d {\n  public interface ISold { void Sell(); }\n  [Serializable] public class Part%1$d : ISold { public Part%1$d(int n) : base() { } public void Sell() { int x = %2$s; } enum State { New } int F = G(3); }\n  public record Price(int Amount);\n  record struct Pair%1$d(int A, int B) { int Sum() => A + B; }\n  struct Box { int a; }\n}\n", key, value)
    files = p.select(F.format_string("p%d.rs", key).alias("path"), rust.alias("content")).unionByName(p.select(F.format_string("p%d.cs", key).alias("path"), sharp.alias("content")))
    return symbols.parse_symbols(files)[0].select("path", "kind", "scope", "name")


def symbol_changes(spark, sf_dir):
    # Both versions in one call: contents that they share are parsed once, and a call's steps are planned once.
    files = [_sources(spark, sf_dir, v).withColumn("version", F.lit(v)) for v in (0, 1)]
    found = saved(symbols.parse_symbols(files[0].unionByName(files[1]), ("version", "path"))[0])
    before, after = (found.where(F.col("version") == v).drop("version") for v in (0, 1))
    return symbols.ast_diff(before, after).select("path", "change", "kind", "before_name", "after_name")


def near_documents(spark, sf_dir):
    """Every document with the class of those of the same language that have the same tokens,
    and its links to classes that share 90% of their tokens, however short a text is; without
    a token, a language or an id it is in no class."""
    d = _table(spark, sf_dir, "documents").select("lang", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = bags.like_classes(d, ("lang",), "doc_id", "text", text.code_tokens, 900, 1, 1)
    found = found.select("lang", "doc_id", "class_id", "n_links", F.col("permille").cast("long").alias("permille"))
    lone = d.where("lang IS NULL OR doc_id IS NULL").select("lang", "doc_id").distinct()
    none = F.lit(None).cast("long")
    return found.unionByName(lone.select("lang", "doc_id", none.alias("class_id"), F.lit(0).cast("long").alias("n_links"), none.alias("permille")))


def version_grid(spark, sf_dir):
    """Lines of a document as a base, and two made-up versions that lack some and add others."""
    lines = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.code_lines(F.col("text"))).alias("ix", "line")).select("doc_id", "ix")
    n = F.col("ix")
    kept = lines.where(n % 4 != 1).select("doc_id", F.lit(1).alias("doc"), n.alias("base_ix"), (n * 2).alias("other_ix")).unionByName(lines.where(n % 3 != 0).select("doc_id", F.lit(2).alias("doc"), n.alias("base_ix"), (n * 2).alias("other_ix")))
    new = lines.where(n % 5 == 2).select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("doc"), (n * 2 + 1).alias("unit_ix")).unionByName(lines.where(n % 7 == 0).select("doc_id", F.lit(2).alias("doc"), (n * 2).alias("unit_ix")).where("unit_ix % 6 = 0"))
    every = kept.select("doc_id", "doc", F.col("other_ix").alias("unit_ix")).unionByName(new)
    return align.grid(lines.select("doc_id", n.alias("unit_ix")), kept, every, ("doc_id",))


QUERIES = {f.__name__: f for f in (file_ledger, changes_by_kind, file_events, document_copies_ledger, line_hunks, review_events, set_similarity, text_similarity, body_dice, code_lines, line_offsets, text_keys, unicode_keys, decoded_texts, url_paths, xml_escaped, row_heights, search_rows, section_labels, moved_rows, vote_map, nth_occurrence, missing_blobs, import_report, document_units, list_parts, unit_matches, paragraph_context, marker_numbers, changed_turns, turn_moves, unmatched_units, document_hunks, document_comparison, page_rows, renumbered_lines, clipped_ranges, table_moves, label_changes, excerpt_lines, concrete_messages, byte_lines, hunk_excerpts, declared_symbols, declared_kinds, symbol_changes, near_documents, version_grid)}

#: The query that the driver's entry() runs.
FLAGSHIP = "file_ledger"

#: Hunks of pairs p(id, old, new): a table of common subsequences of suffixes, filled
#: a cell a step from its end, then walked from its start; middles only.
_HUNKS = r"""
, l AS (SELECT id, regexp_extract_all(old, '[^\n]*\n|[^\n]+') AS a, regexp_extract_all(new, '[^\n]*\n|[^\n]+') AS b FROM p WHERE old <> new),
f AS (SELECT *, coalesce(list_min(list_filter(range(least(len(a), len(b))), lambda i: a[i + 1] <> b[i + 1])), least(len(a), len(b))) AS pre FROM l),
g AS (SELECT *, coalesce(list_min(list_filter(range(least(len(a), len(b)) - pre), lambda i: a[len(a) - i] <> b[len(b) - i])), least(len(a), len(b)) - pre) AS suf FROM f),
h AS (SELECT id, pre, a[pre + 1 : len(a) - suf] AS a, b[pre + 1 : len(b) - suf] AS b FROM g),
z AS (SELECT *, len(a) AS n, len(b) AS m FROM h),
t(id, k, c) AS (
  SELECT id, (n + 1) * (m + 1), CAST([] AS INTEGER[]) FROM z
  UNION ALL
  SELECT t.id, k - 1, list_append(c, CAST(CASE WHEN (k - 1) // (m + 1) = n OR (k - 1) % (m + 1) = m THEN 0
    WHEN a[(k - 1) // (m + 1) + 1] = b[(k - 1) % (m + 1) + 1] THEN 1 + c[(n + 1) * (m + 1) - (k - 1 + m + 2)]
    ELSE greatest(c[(n + 1) * (m + 1) - (k - 1 + m + 1)], c[(n + 1) * (m + 1) - k]) END AS INTEGER))
  FROM t JOIN z ON t.id = z.id WHERE k > 0
),
d AS (SELECT z.*, c, (n + 1) * (m + 1) AS total FROM z JOIN t ON z.id = t.id WHERE k = 0),
s(id, i, j, step, nth) AS (
  SELECT id, 0, 0, 'start', 0 FROM d
  UNION ALL
  SELECT id, i + CASE WHEN w = 'add' THEN 0 ELSE 1 END, j + CASE WHEN w = 'cut' THEN 0 ELSE 1 END, w, nth + 1 FROM (
    SELECT s.id, i, j, nth, CASE WHEN i < n AND j < m AND a[i + 1] = b[j + 1] THEN 'keep'
      WHEN i < n AND (j = m OR c[total - ((i + 1) * (m + 1) + j)] >= c[total - (i * (m + 1) + j + 1)]) THEN 'cut' ELSE 'add' END AS w
    FROM s JOIN d ON s.id = d.id WHERE i < n OR j < m)
),
q AS (SELECT id, i, j, step, nth, sum(CASE WHEN step IN ('keep', 'start') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY nth) AS run FROM s),
u AS (SELECT q.id, run, min(i - CASE WHEN step = 'cut' THEN 1 ELSE 0 END) AS p0, max(i) AS p1, min(j - CASE WHEN step = 'add' THEN 1 ELSE 0 END) AS r0, max(j) AS r1 FROM q WHERE step IN ('cut', 'add') GROUP BY q.id, run),
o AS (SELECT u.id, row_number() OVER (PARTITION BY u.id ORDER BY run) AS ord, CASE WHEN p1 > p0 AND r1 > r0 THEN 'replace' WHEN p1 > p0 THEN 'delete' ELSE 'insert' END AS kind,
  CAST(p0 + pre AS BIGINT) AS before_start, CAST(p1 + pre AS BIGINT) AS before_end, CAST(r0 + pre AS BIGINT) AS after_start, CAST(r1 + pre AS BIGINT) AS after_end FROM u JOIN z ON u.id = z.id)
"""
_W = r"[0-9]+(?:[.,][0-9]+)*|\p{L}[\p{L}\p{M}\p{Nd}]*"
_C = r"[\p{L}\p{M}\p{Nd}\p{Pc}]+|[^\p{L}\p{M}\p{Nd}\p{Pc}\s]+"
ORACLE_SQL = {
    "file_ledger": _SNAP + "SELECT * FROM l",
    "changes_by_kind": _SNAP + "SELECT cmp, kind, count(*) AS n FROM l GROUP BY cmp, kind",
    "document_copies_ledger": "SELECT lang, sha256(coalesce(text, '')) AS sha, count(*) AS copies, min(source || '/' || doc_id || '.txt') AS first_path, CAST(max(strlen(coalesce(text, ''))) AS BIGINT) AS length FROM documents GROUP BY 1, 2",
    "set_similarity": _TURNS + f""", s AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(old), '{_W}')) AS a, list_distinct(regexp_extract_all(lower(new), '{_W}')) AS b FROM p),
      n AS (SELECT *, len(list_intersect(a, b)) AS c FROM s)
      SELECT conv_id, turn, CAST(len(a) AS BIGINT) AS n_old, CAST(len(b) AS BIGINT) AS n_new,
      round(CASE WHEN len(a) + len(b) - c > 0 THEN c / (len(a) + len(b) - c) ELSE 0.0 END, 9) AS jaccard,
      round(CASE WHEN least(len(a), len(b)) > 0 THEN c / least(len(a), len(b)) ELSE 0.0 END, 9) AS containment FROM n""",
    "body_dice": _TURNS + f""", x AS (SELECT pid, w, count(*) AS n FROM (SELECT conv_id || '/' || turn AS pid, unnest(regexp_extract_all(old, '{_C}')) AS w FROM p) GROUP BY ALL),
      y AS (SELECT pid, w, count(*) AS n FROM (SELECT conv_id || '/' || turn AS pid, unnest(regexp_extract_all(new, '{_C}')) AS w FROM p) GROUP BY ALL),
      sx AS (SELECT pid, sum(n) AS n, count(*) AS k FROM x GROUP BY pid), sy AS (SELECT pid, sum(n) AS n FROM y GROUP BY pid),
      c AS (SELECT x.pid, sum(least(x.n, y.n)) AS s FROM x JOIN y ON x.pid = y.pid AND x.w = y.w GROUP BY x.pid)
      SELECT c.pid, CAST(floor(2000 * s / (sx.n + sy.n)) AS BIGINT) AS permille FROM c JOIN sx USING (pid) JOIN sy USING (pid) WHERE sx.n >= 12 AND sy.n >= 12 AND sx.k >= 8""",
    "code_lines": r"SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+')) AS BIGINT) AS n_lines, sha256(text) AS content_id FROM documents",
    "line_offsets": r"""WITH l AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\n]*\n|[^\n]+')) AS line, generate_subscripts(regexp_extract_all(text, '[^\n]*\n|[^\n]+'), 1) - 1 AS line_no FROM documents),
      s AS (SELECT doc_id, line_no, strlen(line) AS b, length(line) + len(regexp_extract_all(line, '[\x{10000}-\x{10FFFF}]')) AS u FROM l),
      r AS (SELECT *, sum(b) OVER w AS be, sum(u) OVER w AS ue FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))
      SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, CAST(be - b AS BIGINT) AS byte_start, CAST(be AS BIGINT) AS byte_end, CAST(ue - u AS BIGINT) AS utf16_start, CAST(ue AS BIGINT) AS utf16_end FROM r""",
    "text_keys": r"""SELECT doc_id, sha256(lower(regexp_replace(text, '\s+', '', 'g'))) AS compact, sha256(regexp_replace(text, '^[\s\p{Cf}]+|[\s\p{Cf}]+$', '', 'g')) AS trimmed,
      sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS collapsed, (NOT regexp_matches(text, '[\p{L}\p{Nd}]')) AND length(text) > 0 AS punctuation,
      CAST(len(regexp_extract_all(text, '(?m)^\s*[0-9]{1,3}[.)]\s')) AS BIGINT) AS numbers,
      len(regexp_extract_all(text, '(?im)^\s*(?:(?:article|section|clause|§)\s*(?:\d+|[IVXLC]+)\b|제\s*\d+\s*조)')) >= 2 AS legal FROM documents""",
    "decoded_texts": "SELECT doc_id, sha256(text) AS utf16_id, sha256(text) AS utf8_id FROM documents",
    "url_paths": rf"""WITH u AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS p FROM pages), e AS (SELECT *, lower(regexp_extract(p, '\.([^./\\]+)$', 1)) AS x, string_split_regex(p, '[/\\]') AS s FROM u)
      SELECT page_id, x AS extension, x IN ({', '.join(repr(x) for x in text.CODE_EXTENSIONS + ['docx', 'txt'])}) AS supported,
      length(p) > 0 AND NOT regexp_matches(p, '^([/\\]|[A-Za-z]:)') AND len(list_filter(s, lambda q: q IN ('', '.', '..') OR lower(q) IN ({', '.join(repr(x) for x in text.EXCLUDED_FOLDERS)}))) = 0 AS safe FROM e""",
    "xml_escaped": r"SELECT page_id, sha256(replace(replace(replace(replace(regexp_replace(html, '[^\x09\x0A\x0D\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS xml_id FROM pages".replace('\\"', '"'),
    "row_heights": r"SELECT conv_id, turn, CAST(greatest(CASE WHEN role = 'system' THEN 24 ELSE 0 END, least(409, 6 + 15 * list_sum(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: greatest(1, CAST(ceil((length(x) + length(regexp_replace(x, '[\x00-\x7F]', '', 'g'))) / 40.0) AS BIGINT)))))) AS BIGINT) AS height FROM conversations",
    "search_rows": r"SELECT doc_id FROM documents WHERE contains(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 'the of') OR contains(lower(regexp_replace(text, '\s+', '', 'g')), 'theof')",
    "section_labels": "WITH t AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) SELECT conv_id, turn, CASE WHEN coalesce(b, '') <> coalesce(role, '') THEN role END AS section_label FROM t",
    "moved_rows": """WITH o AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey) AS old_ix, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey) AS new_ix FROM lineitem)
      SELECT l_orderkey, old_ix, new_ix, coalesce(max(new_ix) OVER (PARTITION BY l_orderkey ORDER BY old_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > new_ix, false) OR coalesce(min(new_ix) OVER (PARTITION BY l_orderkey ORDER BY old_ix ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) < new_ix, false) AS crossed FROM o""",
    "vote_map": """WITH v AS (SELECT l_returnflag, l_partkey, l_suppkey, count(*) AS votes FROM lineitem GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_partkey ORDER BY votes DESC, l_suppkey) AS a, row_number() OVER (PARTITION BY l_returnflag, l_suppkey ORDER BY votes DESC, l_partkey) AS b FROM v)
      SELECT l_returnflag, l_partkey, l_suppkey, votes FROM r WHERE a = 1 AND b = 1""",
    "nth_occurrence": """WITH d AS (SELECT text, doc_id, CAST(substring(source, 4, 3) AS INT) < 10 AS h FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY h, text ORDER BY doc_id) AS nth FROM d)
      SELECT a.doc_id, b.doc_id AS doc_id_right, a.nth FROM n a JOIN n b ON a.h AND NOT b.h AND a.text = b.text AND a.nth = b.nth""",
    "missing_blobs": "SELECT DISTINCT sha256(coalesce(text, '')) AS sha, CAST(strlen(coalesce(text, '')) AS BIGINT) AS length FROM documents WHERE sha256(coalesce(text, '')) NOT IN (SELECT sha256(coalesce(text, '')) FROM benchmark)",
    "import_report": """WITH c AS (SELECT substring(source, 1, 3) || '/' || lang || '.txt' AS path, sha256(text) AS sha FROM documents), k AS (SELECT DISTINCT 'src/en.txt' AS path, sha256(text) AS sha FROM benchmark),
      s AS (SELECT c.path, c.sha, row_number() OVER (PARTITION BY c.path, c.sha) AS n, k.sha IS NOT NULL AS known FROM c LEFT JOIN k ON c.path = k.path AND c.sha = k.sha)
      SELECT count(*) FILTER (sha IS NOT NULL AND NOT known AND n = 1) AS added, count(*) FILTER (sha IS NOT NULL AND (known OR n > 1)) AS duplicate, CAST(0 AS BIGINT) AS unsupported, count(*) FILTER (sha IS NULL) AS missing FROM s""",
    "paragraph_context": """SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, text ORDER BY turn) AS nth,
      sha256(coalesce(string_agg(text, '|') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), '')) AS before,
      sha256(coalesce(string_agg(text, '|') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING), '')) AS after FROM conversations""",
    "marker_numbers": """WITH m AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS stable_ord, CASE WHEN l_linestatus = 'F' THEN l_linenumber END AS num FROM lineitem)
      SELECT l_orderkey, stable_ord, CAST(coalesce(num, coalesce(max(num) OVER (PARTITION BY l_orderkey), 0) + row_number() OVER (PARTITION BY l_orderkey, num IS NULL ORDER BY stable_ord)) AS BIGINT) AS num FROM m""",
    "changed_turns": _TURNS + "SELECT conv_id, turn, CASE WHEN old <> new THEN CAST(1 AS BIGINT) ELSE 0 END AS n_markers, old <> new AS changed FROM p",
    "turn_moves": """WITH t AS (SELECT role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations), v AS (SELECT role, next_role, count(*) AS votes FROM t WHERE next_role IS NOT NULL GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY votes DESC, next_role) AS a, row_number() OVER (PARTITION BY next_role ORDER BY votes DESC, role) AS b FROM v) SELECT role, next_role, votes FROM r WHERE a = 1 AND b = 1""",
    "line_hunks": _TURNS.replace("WITH t", "WITH RECURSIVE t0").replace("FROM t WHERE", "FROM t0 WHERE").replace("p AS (SELECT *", "p AS (SELECT conv_id || '/' || turn AS id, *") + _HUNKS + """SELECT CAST(split_part(id, '/', 1) AS BIGINT) AS conv_id, CAST(split_part(id, '/', 2) AS BIGINT) AS turn, kind, ord, before_start, before_end, after_start, after_end, false AS limited FROM o""",
    "document_hunks": r"""WITH RECURSIVE x AS (SELECT doc_id, source, regexp_replace(coalesce(text, ''), '(?m)^(.{0,3}).*$', '\1', 'g') AS new FROM documents),
      p AS (SELECT * FROM (SELECT doc_id AS id, new, lag(new) OVER (PARTITION BY source ORDER BY doc_id) AS old FROM x) WHERE old IS NOT NULL)""" + _HUNKS + "SELECT id AS doc_id, kind, ord, before_start, before_end, after_start, after_end FROM o",
    "file_events": _SNAP + """, e AS (SELECT cmp, kind, before_path, after_path, concat_ws(' -> ', before_path, CASE WHEN kind = 'renamed' THEN after_path END) AS description,
        CASE WHEN kind = 'renamed' THEN 'equal content, unique on both sides' ELSE 'content hash' END AS evidence FROM l)
      SELECT *, sha256('{"kind":"' || kind || '","before":{' || coalesce('"path":"' || before_path || '",', '') || '"location":"file"},"after":{' || coalesce('"path":"' || after_path || '",', '') || '"location":"file"},"description":"' || description || '","evidence":"' || evidence || '","cmp":' || cmp || '}') AS event_id FROM e""",
    "page_rows": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 250 OFFSET 500",
    "renumbered_lines": "SELECT l_orderkey % 50 AS comparison_id, l_orderkey AS row_id, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey % 50 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS num FROM lineitem",
    "clipped_ranges": r"""WITH l AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\n]*\n|[^\n]+')) AS line, generate_subscripts(regexp_extract_all(text, '[^\n]*\n|[^\n]+'), 1) - 1 AS line_no FROM documents),
      s AS (SELECT doc_id, line_no, length(line) + len(regexp_extract_all(line, '[\x{10000}-\x{10FFFF}]')) AS u FROM l),
      r AS (SELECT doc_id, line_no, sum(u) OVER (PARTITION BY doc_id ORDER BY line_no) - u AS a, sum(u) OVER (PARTITION BY doc_id ORDER BY line_no) AS b FROM s),
      m AS (SELECT doc_id, (length(text) + len(regexp_extract_all(text, '[\x{10000}-\x{10FFFF}]'))) // 2 AS c FROM documents)
      SELECT r.doc_id, 'delete' AS kind, CAST(line_no AS BIGINT) AS line_no, CAST(greatest(a, c - 50) - a AS BIGINT) AS start, CAST(least(b, c + 50) - a AS BIGINT) AS "end" FROM r JOIN m ON r.doc_id = m.doc_id WHERE c - 50 < b AND c + 50 > a""",
    "table_moves": """WITH u AS (SELECT l_orderkey, l_partkey % 3 AS t, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey) AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem),
      f AS (SELECT l_orderkey, t, min(o) AS o, arg_min(n, o) AS n FROM u WHERE t > 0 GROUP BY ALL),
      m AS (SELECT DISTINCT f.l_orderkey, f.t FROM f JOIN u ON f.l_orderkey = u.l_orderkey AND u.t <> f.t AND (f.o < u.o) <> (f.n < u.n)),
      r AS (SELECT DISTINCT a.l_orderkey, a.o FROM u a JOIN u b ON a.l_orderkey = b.l_orderkey AND a.t = b.t AND a.t > 0 AND a.o <> b.o AND (a.o < b.o) <> (a.n < b.n))
      SELECT u.l_orderkey, u.o AS old_ix, u.n AS new_ix, CASE WHEN m.t IS NOT NULL THEN 'table moved' ELSE 'row moved' END AS reason
      FROM u LEFT JOIN m ON u.l_orderkey = m.l_orderkey AND u.t = m.t LEFT JOIN r ON u.l_orderkey = r.l_orderkey AND u.o = r.o WHERE u.t > 0 AND (m.t IS NOT NULL OR r.o IS NOT NULL)""",
    "label_changes": """WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS old, coalesce(lead(role) OVER (PARTITION BY conv_id ORDER BY turn), '') AS new FROM conversations)
      SELECT conv_id, turn, CASE WHEN old = new THEN NULL WHEN old = '' THEN 'insert' ELSE 'original' END AS kind, CASE WHEN old <> new THEN old END AS old, CASE WHEN old <> new THEN new END AS new FROM t""",
    "excerpt_lines": r"""WITH l AS (SELECT doc_id, regexp_extract(text, '^([^\r\n]*)', 1) AS x FROM documents) SELECT doc_id, sha256(CASE WHEN length(x) > 40 THEN substring(x, 1, 39) || '…' ELSE x END) AS excerpt_id FROM l""",
    "concrete_messages": """WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag <> 'N' THEN 'status' ELSE 'retitled' END AS code, CASE WHEN l_returnflag = 'R' THEN 'changed' ELSE 'moved' END AS old FROM lineitem)
      SELECT * FROM m WHERE code <> 'status' OR (old <> 'changed' AND l_orderkey NOT IN (SELECT l_orderkey FROM m WHERE code <> 'status'))""",
    "byte_lines": r"""WITH l AS (SELECT doc_id, strlen(text) // 2 AS byte, strlen(text) AS size, unnest(regexp_extract_all(text, '[^\n]*\n|[^\n]+')) AS line, generate_subscripts(regexp_extract_all(text, '[^\n]*\n|[^\n]+'), 1) - 1 AS line_no FROM documents),
      r AS (SELECT doc_id, line_no, byte, sum(strlen(line)) OVER (PARTITION BY doc_id ORDER BY line_no) AS b FROM l)
      SELECT d.doc_id, CAST(strlen(d.text) // 2 AS BIGINT) AS byte, CAST((SELECT min(line_no) FROM r WHERE r.doc_id = d.doc_id AND b > strlen(d.text) // 2) AS BIGINT) AS line_no FROM documents d WHERE text IS NOT NULL""",
    "hunk_excerpts": r"""WITH l AS (SELECT doc_id, unnest(range(len(regexp_extract_all(text, '[^\n]*\n|[^\n]+')))) AS line_no FROM documents)
      SELECT doc_id, line_no, CASE WHEN line_no % 10 BETWEEN 2 AND 4 THEN line_no // 10 END AS hunk_ord FROM l""",
    "declared_symbols": """WITH p AS (SELECT p_partkey, p_size, 'p' || p_partkey || '.rs' AS path, 'part_' || p_partkey AS fn, '// fn not_here() {}' || chr(10) || 'const MARK: &str = "struct No {}";' || chr(10) AS head FROM part),
      q AS (SELECT *, head || 'pub fn ' || fn || '(n: i32) -> i32 { n * ' || p_size || ' + ' || p_partkey || ' }' || chr(10) || 'mod inner { ' AS before_struct FROM p)
      SELECT path, 'rust' AS language, 'const' AS kind, '' AS scope, 'MARK' AS name, CAST(strpos(head, 'const') - 1 AS BIGINT) AS byte_start FROM q
      UNION ALL SELECT path, 'rust', 'function', '', fn, strlen(head) FROM q UNION ALL SELECT path, 'rust', 'struct', 'mod:inner', 'Size_' || p_size, strlen(before_struct) FROM q""",
    "declared_kinds": """WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS k FROM part WHERE p_partkey % 10 <> 7),
      r AS (SELECT k, unnest([['trait', '', 'Priced' || k], ['function', 'trait:Priced' || k, 'price'], ['enum', '', 'Brand' || k], ['type', '', 'Alias' || k], ['const', '', 'SIZE'], ['struct', '', 'Part'], ['function', 'impl:Brand' || k, 'price']]) AS d FROM p),
      c AS (SELECT k, 'namespace:Shop' || k AS n, 'namespace:Shop' || k || '/class:Part' || k AS m FROM p),
      s AS (SELECT k, unnest([['interface', n, 'ISold'], ['method', n || '/interface:ISold', 'Sell'], ['class', n, 'Part' || k], ['constructor', m, 'Part' || k], ['method', m, 'Sell'], ['enum', m, 'State'], ['record', n, 'Price'], ['record', n, 'Pair' || k], ['method', n || '/record:Pair' || k, 'Sum'], ['struct', n, 'Box']]) AS d FROM c)
      SELECT 'p' || k || '.rs' AS path, d[1] AS kind, d[2] AS scope, d[3] AS name FROM r UNION ALL SELECT 'p' || k || '.cs', d[1], d[2], d[3] FROM s""",
    "symbol_changes": """SELECT 'p' || p_partkey || '.rs' AS path, CASE p_partkey % 5 WHEN 1 THEN 'rename' WHEN 2 THEN 'modify' ELSE 'delete' END AS change, CASE p_partkey % 5 WHEN 3 THEN 'struct' ELSE 'function' END AS kind,
      CASE p_partkey % 5 WHEN 3 THEN 'Size_' || p_size ELSE 'part_' || p_partkey END AS before_name, CASE p_partkey % 5 WHEN 1 THEN 'renamed_' || p_partkey WHEN 2 THEN 'part_' || p_partkey END AS after_name FROM part WHERE p_partkey % 5 IN (1, 2, 3)""",
    "version_grid": r"""WITH l AS (SELECT doc_id, unnest(range(len(regexp_extract_all(text, '[^\n]*\n|[^\n]+')))) AS n FROM documents),
      m AS (SELECT doc_id, 1 AS doc, n AS base_ix, n * 2 AS other_ix FROM l WHERE n % 4 <> 1 UNION ALL SELECT doc_id, 2, n, n * 2 FROM l WHERE n % 3 <> 0),
      a AS (SELECT doc_id, doc, other_ix AS unit_ix FROM m UNION ALL SELECT doc_id, unnest([1, 2]), n * 2 + 1 FROM l WHERE n % 5 = 2 UNION ALL SELECT doc_id, 2, n * 2 FROM l WHERE n % 7 = 0 AND n % 3 = 0),
      o AS (SELECT a.doc_id, a.doc, a.unit_ix, m.base_ix, last_value(m.base_ix IGNORE NULLS) OVER (PARTITION BY a.doc_id, a.doc ORDER BY a.unit_ix) AS slot FROM a LEFT JOIN m ON m.doc_id = a.doc_id AND m.doc = a.doc AND m.other_ix = a.unit_ix),
      r AS (SELECT l.doc_id, l.n AS slot, 0 AS added, l.n AS base_ix, m.other_ix, m.doc FROM l LEFT JOIN m ON m.doc_id = l.doc_id AND m.base_ix = l.n
        UNION ALL SELECT doc_id, coalesce(slot, -1), 1, NULL, unit_ix, doc FROM o WHERE base_ix IS NULL)
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY slot, added, doc NULLS FIRST, other_ix NULLS FIRST) AS row_id, base_ix, other_ix, doc FROM r""",
    "near_documents": f"""WITH g AS (SELECT DISTINCT lang, doc_id FROM documents),
      t AS (SELECT lang, doc_id, w, count(*) AS n FROM (SELECT lang, doc_id, unnest(regexp_extract_all(text, '{_C}')) AS w FROM documents) GROUP BY ALL),
      s AS (SELECT lang, doc_id, CAST(sum(n) AS BIGINT) AS n, md5(string_agg(w || chr(0) || n, chr(0) ORDER BY w)) AS bag FROM t GROUP BY lang, doc_id),
      k AS (SELECT lang, doc_id, n, min(doc_id) OVER (PARTITION BY lang, bag) AS class_id FROM s),
      r AS (SELECT t.*, k.n AS size FROM t JOIN k ON t.lang = k.lang AND t.doc_id = k.doc_id AND k.class_id = k.doc_id),
      c AS (SELECT a.doc_id AS x, b.doc_id AS y, CAST(floor(2000 * sum(least(a.n, b.n)) / (any_value(a.size) + any_value(b.size))) AS BIGINT) AS permille FROM r a JOIN r b ON a.lang = b.lang AND a.doc_id <> b.doc_id AND a.w = b.w GROUP BY a.doc_id, b.doc_id),
      l AS (SELECT x, count(*) AS n_links, max(permille) AS permille FROM c WHERE permille >= 900 GROUP BY x)
      SELECT g.lang, g.doc_id, k.class_id, coalesce(n_links, 0) AS n_links, permille FROM g LEFT JOIN k USING (lang, doc_id) LEFT JOIN l ON l.x = k.class_id""",
}
