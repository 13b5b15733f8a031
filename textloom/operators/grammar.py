"""Declarations of Rust and C# sources as relations of tokens.

A source is cut into tokens by one lexical pattern a language; the tokens of a batch
of contents are columns of one Arrow batch: byte places are running sums, brackets
meet by their level, a token's parent is the last opening bracket of its level, and
siblings are numbered into segments that end at a semicolon or a closing brace.
A segment is a row, an item or a statement; its head (attributes, modifiers, keyword,
name) tells the declaration, its last tokens the body. Scopes are the intervals
that hold it.

Every distinct content is parsed once, whatever number of files has it. Contents are
dealt over tasks by their bytes; a batch is worked on CALL_TOKENS tokens, or one content
of at most MOST_BYTES, at a time, so tokens are never rows that are shuffled or sorted.

A source is refused (supported = false) if its brackets don't match or nest more
than MOST_DEPTH deep, if a literal or comment doesn't end, if two neighbouring
tokens can never follow each other (FOLLOW: an operator or comma before a closing
bracket or a semicolon, a literal beside a word or literal, a declaring keyword
without a name), or if it is too large. Inside of Rust macros, where anything may
follow anything, only brackets and literals are looked at. That is less than a whole
grammar: what is refused is no program, what is accepted need not be one.

Kinds: function, struct, enum, trait, type and const of Rust; class, struct,
interface, enum, record, method and constructor of C#. Modules, implementations,
traits, namespaces and types are scopes, named kind:name and joined by a slash.

Defined cases: a null source is unsupported, an empty one is supported and
declares nothing; repeated rows give their declarations each; other columns don't
matter; an empty table gives empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import bounded_batches, saved

MOST_BYTES, MOST_SYMBOLS, MOST_DEPTH = 2 << 20, 5_000, 128
#: Bytes of text of one task, and tokens that are arrays at one time.
TASK_BYTES, CALL_TOKENS = 8 << 20, 1 << 18

# Lexical patterns. Loops are possessive, so that long tokens need no stack; a comment that
# does not end is one token to the end of the text, so that no later start is tried again.


def _nested(open_: str, close: str, inner: str, levels: int) -> str:
    """A bracketed pattern that holds itself up to `levels` deep."""
    out = f"{open_}(?:{inner})*+{close}"
    for _ in range(levels):
        out = f"{open_}(?:{inner}|{out})*+{close}"
    return out


_COMMENT = _nested(r"/\*", r"\*+/", r"[^*/]++|/(?!\*)|\*++(?!/)", 3)
_NUMBER = r"\d[\d_]*+(?:\.\d[\d_]*+)?(?:[eE][+-]?\d+)?\w*+"
_SPACE = r"[^\S\n]*+\n|[^\S\n]++"
_RUST_OPERATOR = r"=>|->|::|\.\.=|\.\.\.|\.\.|==|!=|<=|>=|&&|\|\||[-+*/%^&|]=|[\s\S]"
_RUST_TOKENS = (
    rf"//[^\n]*+|{_COMMENT}|/\*[\s\S]*+|(?:b|c)?r(#*)\"[\s\S]*?\"\1|[bc]?\"(?:[^\"\\]++|\\[\s\S])*+\"|b?'(?:\\(?:u\{{[^}}]*+\}}|x..|[\s\S])|[^'\\\n])'|'[\p{{L}}_][\p{{L}}\p{{N}}_]*+"
    rf"|{_NUMBER}|(?:r#)?[\p{{L}}_][\p{{L}}\p{{N}}_]*+|{_SPACE}|{_RUST_OPERATOR}"
)
_HOLE = r"\{(?:[^{}\"]++|\"(?:[^\"\\]++|\\[\s\S])*+\"|\{[^{}]*+\})*+\}"
_TYPE_ARGUMENTS = _nested("<", ">", r"[\p{L}\p{N}_\s,.?:@\[\]()*]++", 3)
_SHARP_OPERATOR = r"=>|->|::|\?\?=|\?\?|\?\.|\.\.|==|!=|<=|>=|&&|\|\||\+\+|--|[-+*/%^&|]=|[\s\S]"
_SHARP_TOKENS = (
    rf"//[^\n]*+|/\*[\s\S]*?\*/|/\*[\s\S]*+|(?:(?<=\n)|\A)[^\S\n]*+#[^\n]*+|\$*+(\"\"\"++)[\s\S]*?\1\"*+|(?:\$@|@\$)\"(?:[^\"{{]++|\"\"|\{{\{{|{_HOLE})*+\"|\$\"(?:[^\"\\{{]++|\\[\s\S]|\{{\{{|{_HOLE})*+\""
    rf"|@\"(?:[^\"]++|\"\")*+\"|\"(?:[^\"\\\n]++|\\[\s\S])*+\"|'(?:\\(?:u[0-9a-fA-F]{{4}}|x[0-9a-fA-F]++|[\s\S])|[^'\\\n])'"
    rf"|{_NUMBER}|@?[\p{{L}}_][\p{{L}}\p{{N}}_]*+|(?<=[\p{{L}}\p{{N}}_]){_TYPE_ARGUMENTS}(?=\s*+(?:[(){{}}\[\];:,.?=>&*]|[\p{{L}}_]|\z))|{_SPACE}|{_SHARP_OPERATOR}"
)

_RUST_KINDS = {"fn": "function", "struct": "struct", "enum": "enum", "trait": "trait", "type": "type", "const": "const"}
_RUST_HEADS = (*_RUST_KINDS, "mod", "impl")
_RUST_MODIFIERS = ("pub", "default", "async", "unsafe", "safe", "auto", "extern")
_SHARP_TYPES = ("class", "struct", "interface", "enum", "record")
_SHARP_MODIFIERS = ("public", "private", "protected", "internal", "static", "abstract", "sealed", "partial", "virtual", "override", "async", "extern", "unsafe", "new", "readonly", "ref", "required", "file")
#: Words that may stand behind a literal.
_RUST_BEHIND = ("as", "if", "else", "in")
_SHARP_BEHIND = ("as", "in", "is", "and", "or", "not", "when", "with", "switch", "select", "where", "orderby", "ascending", "descending", "join", "on", "equals", "into", "group", "by", "let", "from", "u8")
_NO_NAMES = ("return", "new", "await", "throw", "in", "is", "as", "using", "yield", "case", "goto", "out", "operator", "delegate", "event", "implicit", "explicit", "this", "base", "if", "while", "for", "foreach", "switch", "lock", "catch", "fixed", "typeof", "nameof", "sizeof", "default", "checked", "unchecked", "where", "get", "set")
_INFIX = ("=", "==", "!=", "<=", ">=", "&&", "||", "+=", "-=", "*=", "/=", "%=", "^=", "&=", "|=", "-", "/", "%", "^", "=>", "->", "::", "??", "??=", "?.")


_CLASSES = ("sign", "broken", "literal", "life", "word", "arguments")
_SIGN, _BROKEN, _LITERAL, _LIFE, _WORD, _ARGUMENTS = range(6)
_TRIVIA = r"^(?:[\s\x0b]+|//[\s\S]*|/\*[\s\S]*\*/|[ \t\x0b\f\r]*#[^\n]+|[\x{85}\x{2028}\x{2029}])$"
_LITERALS = r"^(?:[bc]?r#*\"|[bc]?\"|b?'[\s\S]*'$|[$@]+\"|'[^']*'$|\d)"
_TOKEN = pa.struct([("open", pa.int64()), ("end", pa.int64()), ("t", pa.string()), ("c", pa.string()), ("semi", pa.int64())])
_SEGMENT = pa.struct([("parent", pa.int64()), ("h", pa.int32()), ("s", pa.int32()), ("g", pa.int32()), ("a", pa.list_(_TOKEN))])
_PARSED = "struct<bad:boolean,segments:array<struct<parent:bigint,h:int,s:int,g:int,a:array<struct<open:bigint,end:bigint,t:string,c:string,semi:bigint>>>>>"


def _tokens(contents: DataFrame) -> DataFrame:
    """contents with the tokens of their texts, spaces and comments included."""
    rust = F.col("language") == "rust"
    return contents.withColumn("tokens", F.when(rust, F.regexp_extract_all("text", F.lit(_RUST_TOKENS), F.lit(0))).otherwise(F.regexp_extract_all("text", F.lit(_SHARP_TOKENS), F.lit(0))))


def _bracketed(tokens: DataFrame) -> DataFrame:
    """tokens with bad (brackets that don't match, a token that the next one can never
    follow) and, if not bad, the segments inside of braces or of nothing that have a word
    and an end: the place of the bracket around (-1: none), h, where the head is (behind
    attributes and modifiers), of Rust s, where the item starts (behind attributes), of C# g,
    where the parameters of a member end (the first round group behind a name), and the
    siblings a in order; a bracketed group stands there as its closing bracket."""

    def parsed(language: pa.Array, tokens: pa.Array) -> pa.Array:
        done = np.cumsum(tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        made, at = [], 0
        while at < len(tokens):
            upto = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + CALL_TOKENS, "right")))
            made.append(_parse(language.slice(at, upto - at), tokens.slice(at, upto - at)))
            at = upto
        return pa.concat_arrays(made) if made else pa.array([], pa.struct([("bad", pa.bool_()), ("segments", pa.list_(_SEGMENT))]))

    if spark := SparkSession.getActiveSession():
        bounded_batches(spark)
    # An array of one and not two fields of a struct, each of which would cut and parse the texts anew.
    return tokens.select(*[c for c in tokens.columns if c != "tokens"], F.inline(F.array(F.arrow_udf(parsed, _PARSED)("language", "tokens"))))


def _classes(words: pa.Array) -> tuple[np.ndarray, dict[bool, np.ndarray]]:
    """Which of the different tokens are spaces or comments, and the class of each in C# and in Rust."""
    like = lambda pattern: pc.match_substring_regex(words, pattern).to_numpy(zero_copy_only=False)
    starts = lambda s: pc.starts_with(words, s).to_numpy(zero_copy_only=False)
    length = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    quote = pc.is_in(words, value_set=pa.array(['"', "'"])).to_numpy(zero_copy_only=False)
    open_ = starts("/*") & ~(pc.ends_with(words, "*/").to_numpy(zero_copy_only=False) & (length >= 4))
    broken = quote | open_
    tests = [broken, like(_LITERALS), starts("'"), like(r"^(?:r#|@)?[\pL_]"), starts("<") & (length > 2)]
    c = {rust: np.select([t if rust or i != 2 else np.zeros_like(t) for i, t in enumerate(tests)], range(1, 6), _SIGN) for rust in (False, True)}
    return like(_TRIVIA) & ~broken, c


def _sorted_by(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, whether a group of row and key begins), elements of a group as they come."""
    order = np.lexsort((key, row))
    begins = np.ones(len(order), bool)
    begins[1:] = (row[order][1:] != row[order][:-1]) | (key[order][1:] != key[order][:-1])
    return order, begins


def _parse(language: pa.Array, tokens: pa.Array) -> pa.Array:
    """The struct (bad, segments) of each list of tokens, all lists at once."""
    n, lengths, flat = len(tokens), tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), tokens.flatten()
    coded = flat.dictionary_encode()
    words, code, row = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(n), lengths)
    is_rust = pc.equal(language, "rust").fill_null(False).to_numpy(zero_copy_only=False)
    size = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.cumsum(lengths) - lengths
    running = lambda x, first: np.cumsum(x) - np.concatenate([[0], np.cumsum(x)])[first][row]
    end = running(size, first)
    trivia, classes = _classes(words)
    kept = np.flatnonzero(~trivia[code])
    end, at, code, row = end[kept], (end - size)[kept], code[kept], row[kept]
    rust, total = is_rust[row], len(kept)
    first = np.searchsorted(row, np.arange(n))
    c = np.where(rust, classes[True][code], classes[False][code])
    among = lambda *ts: pc.is_in(words, value_set=pa.array(ts)).to_numpy(zero_copy_only=False)[code]

    def shifted(x, k, fill):
        """The value of the token k before (behind, if negative) of the same content."""
        out = np.full_like(x, fill)
        if 0 < abs(k) < total:
            to, of = (slice(k, None), slice(None, -k)) if k > 0 else (slice(None, k), slice(-k, None))
            out[to] = np.where(row[to] == row[of], x[of], fill)
        return out

    opening, closing = [among(x) for x in "([{"], [among(x) for x in ")]}"]
    opens, closes = np.any(opening, axis=0), np.any(closing, axis=0)
    shape = sum((i + 1) * (opening[i] | closing[i]) for i in range(3))
    depth = running(opens.astype(np.int64) - closes, first)
    bang = among("!")
    named = shifted(bang, 1, False) & (shifted(c, 2, -1) == _WORD) & (shifted(at, 1, -1) == shifted(end, 2, -2))
    named |= shifted(bang, 2, False) & (shifted(c, 1, -1) == _WORD) & (shifted(c, 3, -1) == _WORD) & (shifted(at, 2, -1) == shifted(end, 3, -2))
    macro = opens & named & rust
    # Brackets meet by level: a closing one and the one before it of its level.
    which = np.flatnonzero(opens | closes)
    order, begins = _sorted_by(row[which], (depth + closes)[which])
    mate, order = np.full(total, -1), which[order]
    mate[order[1:]] = np.where(begins[1:], -1, order[:-1])
    mate[opens] = -1
    fits = (mate >= 0) & opens[mate] & (shape[mate] == shape) if total else closes
    inside = running(macro.astype(np.int64) - ((mate >= 0) & macro[mate]), first) if total else depth
    bad = (closes & ~fits) | (depth < 0) | (c == _BROKEN) | (depth > MOST_DEPTH)
    bad |= _follow(among, shifted, c, rust) & (inside == 0) & (shifted(inside, -1, -1) == 0)
    order, begins = _sorted_by(row, depth)
    place = np.arange(total)
    last = np.maximum.accumulate(np.where(opens[order], place, -1))
    around = np.full(total, -1)
    around[order] = np.where((last >= np.maximum.accumulate(np.where(begins, place, 0))) & (depth[order] > 0), order[last], -1)
    wrong = np.bincount(row[bad], minlength=n) > 0
    ends_at = np.searchsorted(row, np.arange(n), "right")
    some = ends_at > first
    wrong[some] |= depth[ends_at[some] - 1] != 0
    # Siblings inside of braces or of nothing, in segments.
    own = np.flatnonzero(~wrong[row] & ~opens & (inside == 0) & ((around < 0) | opening[2][around])) if total else place
    parent = np.where(around >= 0, at[around], -1) if total else place
    order, begins = _sorted_by(row[own], parent[own])
    x = own[order]
    segments = _segments(x, begins, c, rust, among)
    if segments is None:
        lists, counts = pa.array([], _SEGMENT), np.zeros(n, np.int64)
    else:
        starts, lengths, h, s, g, semi = segments
        lead = x[starts]
        take = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        e, semi = x[take], semi[take]
        opened = np.where(closes & (mate >= 0), at[mate], at)[e]
        token = pa.StructArray.from_arrays([pa.array(opened, pa.int64()), pa.array(end[e], pa.int64()), words.take(pa.array(code[e])), pa.array(_CLASSES).take(pa.array(c[e])), pa.array(np.where(semi >= 0, end[x[semi]], 0), pa.int64(), mask=semi < 0)], fields=list(_TOKEN))
        a = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), token)
        lists = pa.StructArray.from_arrays([pa.array(parent[lead], pa.int64()), pa.array(h, pa.int32()), pa.array(s, pa.int32(), mask=~rust[lead]), pa.array(g, pa.int32(), mask=g < 0), a], fields=list(_SEGMENT))
        counts = np.bincount(row[lead], minlength=n)
        # Segments come by content already: siblings are sorted by it first.
    found = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), lists)
    return pa.StructArray.from_arrays([pa.array(wrong), found], names=["bad", "segments"])


def _follow(among, shifted, c, rust) -> np.ndarray:
    """True where a token can never be followed by the next one of its content."""
    ahead, nc = lambda *ts: shifted(among(*ts), -1, False), shifted(c, -1, -1)
    behind = lambda *ts: shifted(among(*ts), 1, False)
    ends = ahead(")", "]", "}", ";", ",")
    infix = ((among(*_INFIX) | (~rust & among("."))) & ends) | (rust & among("->") & ahead("{"))
    comma = among(",") & (ahead(";") | (rust & ahead(",")) | (~rust & ahead(")")))
    begins = among("(") & (ahead(",") | (rust & ahead(";")))
    beside = (c == _LITERAL) & ~behind("extern") & ((nc == _LITERAL) | ((nc == _WORD) & ~np.where(rust, ahead(*_RUST_BEHIND), ahead(*_SHARP_BEHIND))))
    no_word = (nc >= 0) & (nc != _WORD)
    unnamed = np.where(rust, no_word & (among("struct", "enum", "trait", "mod") | (among("fn") & ~ahead("("))), no_word & among("class", "interface", "enum", "namespace") & ~behind(":", ",", ".", "="))
    return (infix | comma | begins | beside | unnamed) & ~(rust & behind("#", "!"))


def _segments(x, begins, c, rust, among):
    """(starts, lengths, h, s, g, semi) of the segments of siblings x that may declare: places in x,
    and of each of x the next semicolon among its siblings (-1: none); None if there is no segment."""
    if not len(x):
        return None
    total, place = len(x), np.arange(len(x))
    of = lambda *ts: among(*ts)[x]
    c, rust, ends, semicolon = c[x], rust[x], of(";", "}"), of(";")
    new = begins.copy()
    new[1:] |= ends[:-1]
    starts = np.flatnonzero(new)
    lengths = np.diff(np.append(starts, total))
    group = np.flatnonzero(begins)
    limit = np.repeat(np.append(group[1:], total), np.diff(np.append(group, total)))
    semi = np.minimum.accumulate(np.where(semicolon, place, total)[::-1])[::-1]
    semi = np.where(semi < limit, semi, -1)
    attribute = of("#", "!", "]")
    next_ = np.zeros(total, bool)
    next_[:-1] = of("fn", "async", "unsafe", "extern")[1:] & ~new[1:]
    lead = np.where(rust, attribute | of(*_RUST_MODIFIERS, ")") | (c == _LITERAL) | (of("const") & next_), of(*_SHARP_MODIFIERS, "]"))
    earliest = lambda test: np.minimum.reduceat(np.where(test, place, total), starts)
    h, s = earliest(~lead), earliest(~attribute)
    last = starts + lengths - 1
    # A name: the word before a round group, or before the arguments that stand there.
    named = place - 1
    named[1:] -= c[:-1] == _ARGUMENTS
    g = earliest(of(")") & ~rust & (named >= np.repeat(h, lengths)) & (c[np.maximum(named, 0)] == _WORD))
    declares, head = np.where(rust, of(*_RUST_HEADS), of(*_SHARP_TYPES, "namespace")), np.minimum(h, total - 1)
    fit = np.logical_or.reduceat(c == _WORD, starts) & ends[last] & (h <= last) & (declares[head] | (g <= last))
    if not fit.any():
        return None
    starts, lengths, h, s, g, last = starts[fit], lengths[fit], h[fit], s[fit], g[fit], last[fit]
    return starts, lengths, h - starts, s - starts, np.where(g <= last, g - starts, -1), semi


def _where(a: Column, test) -> Column:
    """The index of the first element that test(element, index) accepts, or null."""
    at = F.array_position(F.transform(a, lambda x, i: F.coalesce(test(x, i), F.lit(False))), True)
    return F.when(at > 0, (at - 1).cast("int"))


def _rust_items(segments: DataFrame) -> DataFrame:
    a = F.col("a")
    token = lambda i: F.get(a, i)
    out = segments.where("language = 'rust'")
    head, last = token(F.col("h"))["t"], F.element_at(a, -1)
    out = out.where(head.isin(*_RUST_HEADS)).withColumn("head", head).withColumn("named", token(F.col("h") + 1))
    block, valued = last["t"] == "}", F.exists("a", lambda x: x["t"] == "=")
    tuple_ = F.when(F.col("head") == "struct", F.get(F.filter("a", lambda x: x["t"] == ")"), F.when(F.exists(F.slice("a", 1, F.col("h") + 1), lambda x: x["t"] == ")"), 1).otherwise(0)))
    ends_at_semi = F.col("head").isin("const", "type")
    kept = F.when(F.col("head") == "impl", block).when(F.col("named.c") != "word", False).when(F.col("head") == "fn", block).when(F.col("head") == "type", valued).otherwise(block | (last["t"] == ";") | ends_at_semi)
    body = F.when(ends_at_semi, None).when(block, F.struct(last["open"], last["end"])).when(tuple_.isNotNull(), F.struct(tuple_["open"], tuple_["end"]))
    kinds = F.create_map(*[F.lit(x) for p in _RUST_KINDS.items() for x in p])
    scope = F.col("head").isin("mod", "impl", "trait") & block
    return out.where(kept).select(
        "cid", "language", "parent", F.try_element_at(kinds, F.col("head")).alias("kind"), "head", F.when(F.col("head") != "impl", F.col("named.t")).alias("name"), token(F.col("s"))["open"].alias("start"),
        F.when(ends_at_semi, last["semi"]).otherwise(last["end"]).alias("end"), body.alias("body"), scope.alias("scoped"), F.when(F.col("head") == "impl", F.struct(token(F.col("h"))["end"].alias("from"), last["open"].alias("to"))).alias("of"),
    )


def _sharp_items(segments: DataFrame) -> DataFrame:
    a = F.col("a")
    token = lambda i: F.get(a, i)
    out = segments.where("language = 'csharp' AND h IS NOT NULL")
    head, last = token(F.col("h"))["t"], F.element_at(a, -1)
    out = out.withColumn("head", head).withColumn("n", F.col("h") + F.when((head == "record") & token(F.col("h") + 1)["t"].isin("class", "struct"), 2).otherwise(1)).withColumn("named", token(F.col("n")))
    typed = F.col("head").isin(*_SHARP_TYPES) & (F.col("named.c") == "word") & ((F.col("head") != "record") | F.coalesce(token(F.col("n") + 1)["t"].isin(")", "}", ";", ":") | (token(F.col("n") + 1)["c"] == "arguments"), F.lit(False)))
    spaced = (F.col("head") == "namespace") & (F.col("named.c") == "word")
    block = last["t"] == "}"
    path = F.array_join(F.transform(F.filter(F.slice(a, F.col("n") + 1, F.size(a)), lambda x: ~x["t"].isin("}", ";")), lambda x: x["t"]), "")
    types = out.where(typed | spaced).select(
        "cid", "language", "parent", F.when(typed, F.col("head")).alias("kind"), "head", F.when(typed, F.col("named.t")).otherwise(path).alias("name"), F.get(a, 0)["open"].alias("start"), last["end"].alias("end"),
        F.when(block, F.struct(last["open"], last["end"])).alias("body"), ((F.col("head") != "enum") | spaced).alias("scoped"), F.lit(None).cast("struct<from:bigint,to:bigint>").alias("of"),
    )
    before = lambda i: F.when(token(i - 1)["c"] == "arguments", i - 2).otherwise(i - 1)
    m = out.where("g IS NOT NULL").where(~(typed | spaced)).withColumn("k", before(F.col("g"))).withColumn("name", token(F.col("k"))["t"])
    lead = F.slice(a, F.col("h") + 1, F.col("k") - F.col("h"))
    plain = ~F.exists(lead, lambda x: x["t"].isin("=", "=>", "~", *_NO_NAMES) | x["c"].isin("literal", "broken") | (x["t"] == "}")) & ~F.col("name").isin(*_NO_NAMES)
    arrow = _where(a, lambda x, i: (i > F.col("g")) & (x["t"] == "="))
    shown = _where(a, lambda x, i: (i > F.col("g")) & (x["t"] == "=>"))
    value = token(F.col("shown"))
    m = m.where(plain).withColumn("shown", shown).withColumn("set", arrow).where("shown IS NOT NULL OR `set` IS NULL")
    body = F.when(F.col("shown").isNotNull(), F.struct(value["open"], value["semi"].alias("end"))).when(block, F.struct(last["open"], last["end"]))
    members = m.where(F.col("shown").isNull() | value["semi"].isNotNull()).select(
        "cid", "language", "parent", F.when(F.size(lead) > 0, "method").otherwise("constructor").alias("kind"), F.lit("member").alias("head"), "name", F.get(a, 0)["open"].alias("start"),
        F.when(F.col("shown").isNotNull(), value["semi"]).otherwise(last["end"]).alias("end"), body.alias("body"), F.lit(False).alias("scoped"), F.lit(None).cast("struct<from:bigint,to:bigint>").alias("of"),
    )
    return types.unionByName(members)


def _owned(items: DataFrame, n: int) -> DataFrame:
    """items without the members whose bracket is no type's body, or that name no constructor of it."""
    owns = F.col("kind").isin(*_SHARP_TYPES) & (F.col("kind") != "enum") & F.col("body").isNotNull() & (F.col("language") == "csharp")
    member = F.col("head") == "member"
    # Dealt by content, as the lists of items are that follow: that is one shuffle.
    out = items.repartition(n, "cid").withColumn("home", F.when(member, F.col("parent")).when(owns, F.col("body.open")))
    out = out.withColumn("owner", F.max(F.when(owns, F.col("name"))).over(Window.partitionBy("cid", "home")))
    return out.where(~member | (F.col("owner").isNotNull() & ((F.col("kind") == "method") | (F.col("name") == F.col("owner"))))).drop("home", "owner")


_ANGLED = _nested("<", ">", r"->|[^<>]", 3)


def _slice(binary: Column, start: Column, end: Column) -> Column:
    return F.substring(binary, (start + 1).cast("int"), (end - start).cast("int")).cast("string")


def declared(contents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """contents (cid, language, text), one row a cid -> (symbols, told).

    symbols: (cid, kind, scope, name, signature, body, source, byte_start, byte_end) in
    contents that are supported; told: (cid, supported)."""
    fit = contents.where(F.col("text").isNotNull() & (F.octet_length("text") <= MOST_BYTES))
    # Contents are dealt over tasks by k, not merged by their bytes: a text is many tokens of work.
    size = fit.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(contents.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    parsed = saved(_bracketed(_tokens(fit.select("cid", "language", "text", F.xxhash64("cid").alias("k")).repartition(n, "k"))).drop("k"))
    segments = parsed.where("NOT bad").select("cid", "language", F.explode("segments").alias("x")).select("cid", "language", "x.*")
    items = _owned(_rust_items(segments).unionByName(_sharp_items(segments)).where("`end` IS NOT NULL"), n)
    # A file-scoped namespace holds what follows it.
    listed = items.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind", "head", "name", "body", "scoped", "of"))).alias("items"))
    whole = parsed.select("cid", "text", "bad").repartition(n, "cid").join(listed, "cid", "left")
    count = F.coalesce(F.size(F.filter("items", lambda x: x["kind"].isNotNull())), F.lit(0))
    ok = ~F.col("bad") & (count <= MOST_SYMBOLS)
    whole = saved(whole.withColumn("supported", F.coalesce(ok, F.lit(False))).select("cid", "text", "items", "supported"))
    binary = F.col("text").cast("binary")
    implemented = lambda x: F.trim(F.regexp_replace(F.regexp_replace(_slice(binary, x["of"]["from"], x["of"]["to"]), r"\s+", " "), rf"^\s*(?:{_ANGLED})?\s*|\s*\bwhere\b.*$", ""))
    title = lambda x: F.concat(x["head"], F.lit(":"), F.when(x["head"] == "impl", F.regexp_replace(implemented(x), r"^.*\bfor\b(?!\s*<)\s*", "")).otherwise(x["name"]))
    through = lambda x: F.when((x["head"] == "namespace") & x["body"].isNull(), F.octet_length("text")).otherwise(x["end"])
    scopes = F.transform(F.filter("items", lambda x: x["scoped"]), lambda x: F.struct(x["start"].alias("start"), through(x).alias("end"), title(x).alias("title")))
    rows = whole.where("supported AND items IS NOT NULL").withColumn("scopes", scopes)
    inside = lambda x: F.array_join(F.transform(F.filter("scopes", lambda s: (s["start"] < x["start"]) & (s["end"] >= x["end"])), lambda s: s["title"]), "/")
    trimmed = lambda c: F.regexp_replace(c, r"\s+$", "")
    shown = lambda x: _slice(binary, x["body"]["open"], x["body"]["end"])
    entry = lambda x: F.struct(
        x["kind"].alias("kind"), inside(x).alias("scope"), x["name"].alias("name"), F.when(x["body"].isNull(), "").otherwise(trimmed(_slice(binary, x["start"], x["body"]["open"]))).alias("signature"),
        F.when(x["body"].isNull(), "").otherwise(F.regexp_replace(shown(x), r"\s*;\s*$", "")).alias("body"), _slice(binary, x["start"], x["end"]).alias("source"), x["start"].cast("int").alias("byte_start"), x["end"].cast("int").alias("byte_end"),
    )
    symbols = rows.select("cid", F.explode(F.transform(F.filter("items", lambda x: x["kind"].isNotNull()), entry)).alias("s")).select("cid", "s.*")
    unfit = contents.where(F.col("text").isNull() | (F.octet_length("text") > MOST_BYTES)).select("cid", F.lit(False).alias("supported"))
    return symbols, whole.select("cid", "supported").unionByName(unfit)
