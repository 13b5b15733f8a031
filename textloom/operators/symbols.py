"""Declarations of Rust and C# sources and their changes.

Declarations come from a scanner of our own: it masks comments and literals
(nested comments, raw, verbatim and interpolated strings), matches brackets, and
finds declaration heads where the grammar allows them; a source whose brackets
don't match is unsupported, like one with a syntax error. Matching is relational:
unique equi-joins from strict to loose, each on what the one before left over.

Kinds: function, struct, enum, trait, type and const of Rust; class, struct,
interface, enum, record, method and constructor of C#. Modules, implementations,
traits, namespaces and types are scopes, named kind:name and joined by a slash;
modules, implementations and namespaces are no declarations.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import code_tokens, meaningful_body
from ..functions.vectorized import vectorized
from ..storage import saved
from .ledger import dice_pairs

MOST_BYTES, MOST_SYMBOLS, MOST_DEPTH = 2 << 20, 5_000, 128
LANGUAGES = {"rs": "rust", "cs": "csharp"}

_RUST_TOKEN = re.compile(r'//[^\n]*|/\*|\b(?:b|c|br|cr)?r(?P<hash>#*)".*?"(?P=hash)|\b[bc]?"(?:\\.|[^"\\])*"|"(?:\\.|[^"\\])*"|b?\'(?:\\(?:u\{[^}]*\}|x..|.)|[^\'\\\n])\'', re.S)
_SHARP_TOKEN = re.compile(r'//[^\n]*|/\*.*?\*/|(?m:^[ \t]*\#[^\n]*)|\$*(?P<q>"{3,}).*?(?P=q)"*|(?P<open>(?:\$@|@\$|\$)")|@"(?:""|[^"])*"|"(?:\\.|[^"\\\n])*"|\'(?:\\(?:u....|x[0-9a-fA-F]+|.)|[^\'\\\n])\'', re.S)


def _comment_end(text: str, start: int) -> int:
    """The end of a comment that may hold others."""
    depth = 0
    for m in re.compile(r"/\*|\*/").finditer(text, start):
        depth += 1 if m.group() == "/*" else -1
        if not depth:
            return m.end()
    return len(text)


def _interpolated_end(text: str, start: int) -> int:
    """The end of an interpolated string whose opening quote ends at start."""
    verbatim, at, depth = "@" in text[start - 3 : start], start, 0
    while at < len(text):
        c, two = text[at], text[at : at + 2]
        if depth:
            if c == '"' or (c in "$@" and (m := _SHARP_TOKEN.match(text, at))):
                m = _SHARP_TOKEN.match(text, at)
                at = _interpolated_end(text, m.end()) if m and m.group("open") else m.end() if m else at + 1
                continue
            depth += (c == "{") - (c == "}")
        elif two in ("{{", "}}") or (verbatim and two == '""') or (c == "\\" and not verbatim):
            at += 2
            continue
        elif c == '"':
            return at + 1
        elif c == "{":
            depth = 1
        at += 1
    return len(text)


def _masked(text: str, language: str) -> str:
    """The text with comments and literals blank, of the same length."""
    token, out, at = _RUST_TOKEN if language == "rust" else _SHARP_TOKEN, [], 0
    while m := token.search(text, at):
        end = m.end()
        if m.group() == "/*":
            end = _comment_end(text, m.start())
        elif language == "csharp" and m.group("open"):
            end = _interpolated_end(text, m.end())
        out += [text[at : m.start()], re.sub(r"[^\n]", " ", text[m.start() : end])]
        at = max(end, m.start() + 1)
    return "".join([*out, text[at:]])


def _brackets(text: str) -> dict[int, int] | None:
    """Places of matching brackets; None if they don't match or nest too deep."""
    pairs, stack = {}, []
    for m in re.finditer(r"[(){}\[\]]", text):
        c = m.group()
        if c in "({[":
            stack.append((c, m.start()))
            if len(stack) > MOST_DEPTH:
                return None
        elif not stack or "({[".index(stack[-1][0]) != ")}]".index(c):
            return None
        else:
            pairs[stack.pop()[1]] = m.start()
    return None if stack else pairs


_ANGLED = r"<(?:[^<>;{}]|<(?:[^<>;{}]|<[^<>;{}]*>)*>)*>"
_RUST = re.compile(
    r"\b(?P<whole>(?:pub\b\s*(?:\([^()]*\)\s*)?)?(?:default\s+)?(?:(?:const|async|unsafe|safe|auto)\s+)*(?:extern\s+)?"
    r"(?:(?P<kind>fn|struct|enum|trait|type|const|mod)\s+(?P<name>(?:r#)?[A-Za-z_]\w*)|(?P<impl>impl)\b))"
)
_RUST_KINDS = {"fn": "function", "struct": "struct", "enum": "enum", "trait": "trait", "type": "type", "const": "const"}
_MODIFIER = r"(?:public|private|protected|internal|static|abstract|sealed|partial|virtual|override|async|extern|unsafe|new|readonly|ref|required|file)"
_LEAD = rf"(?P<whole>(?:\[[^\[\]]*(?:\[[^\[\]]*\][^\[\]]*)*\]\s*)*(?:{_MODIFIER}\s+)*"
_SHARP_TYPE = re.compile(rf"{_LEAD}(?<![\w.])(?:(?P<kind>class|struct|interface|enum|record)\s+(?:(?:class|struct)\s+)?(?P<name>[A-Za-z_]\w*)|(?P<space>namespace)\s+(?P<path>[A-Za-z_][\w.]*)))")
_SHARP_METHOD = re.compile(rf"{_LEAD}(?:(?P<type>(?<![\w.])[A-Za-z_](?:[\w.]|::)*\s*(?:{_ANGLED})?(?:\.\w+(?:{_ANGLED})?)*(?:\s*(?:\[[,\s]*\]|\?|\*))*|\([^()]*\)\??)\s+)?(?<![\w.])(?:[\w.]+(?:{_ANGLED})?\.)?(?P<name>[A-Za-z_]\w*)\s*(?:{_ANGLED})?\s*)(?=\()")
_NOT_TYPES = {"return", "new", "else", "await", "throw", "in", "is", "as", "using", "yield", "case", "goto", "out", "ref", "delegate", "event", "where", "operator", "implicit", "explicit", "this", "base", "get", "set", "record", "struct"}


def _impl_type(text: str) -> str:
    """The type of what follows `impl`: after its generics, and after `for`."""
    text, depth, at = " ".join(text.split()), 0, 0
    if text.startswith("<"):
        for at, c in enumerate(text):
            depth += (c == "<") - (c == ">" and text[at - 1] != "-")
            if not depth:
                break
        text = text[at + 1 :].strip()
    text = re.split(r"\bwhere\b", text)[0].strip()
    return re.split(r"\bfor\b(?!\s*<)", text)[-1].strip()


def _rust(masked: str, closing: dict[int, int]):
    """(kind or None, scope name or None, name, start, body start or None, end) of heads."""
    macros = [(m.end() - 1, closing[m.end() - 1]) for m in re.finditer(r"\b\w+!\s*(?:\w+\s*)?[({\[]", masked)]
    for m in _RUST.finditer(masked):
        if any(a < m.start() < z for a, z in macros):
            continue
        word, at, depth = m["kind"], m.end(), 0
        while at < len(masked):  # the body or the end, outside of brackets and generics
            c = masked[at]
            if c in "([":
                at = closing[at]
            elif c in "{;" or c in ")]}" or (c == "," and depth <= 0):
                break
            elif word in ("const", "type") and c == "=" and masked[at + 1 : at + 2] not in ("=", ">"):
                word = "value"  # a value may hold blocks; only the semicolon ends it
            elif c in "<>":
                depth += (c == "<") - (c == ">" and masked[at - 1] != "-")
            at += 1
            if word == "value":
                while at < len(masked) and masked[at] != ";":
                    at = closing[at] + 1 if masked[at] in "([{" else at + 1
                break
        if at >= len(masked) or masked[at] not in "{;":
            continue
        block = masked[at] == "{"
        end = closing[at] + 1 if block else at + 1
        if m["impl"]:
            if block:
                yield None, f"impl:{_impl_type(masked[m.end():at])}", "", m.start(), at, end
            continue
        name, kind = m["name"], m["kind"]
        if kind == "mod":
            yield None, f"mod:{name}", name, m.start(), at if block else None, end
        elif kind == "fn" and not block:
            continue  # a signature of a trait or of foreign code
        elif kind == "type" and "=" not in masked[m.end() : at]:
            continue  # an associated type without a value
        else:
            body = at if block else None
            if kind == "struct" and not block and "(" in masked[m.end() : at]:
                body = masked.index("(", m.end())
            yield _RUST_KINDS[kind], f"trait:{name}" if kind == "trait" else None, name, m.start(), body, end


def _sharp(masked: str, closing: dict[int, int]):
    types: dict[int, str] = {}
    for m in _SHARP_TYPE.finditer(masked):
        stop = re.compile(r"[{;]").search(masked, m.end())
        if not stop or (m["kind"] == "record" and m["name"] in _NOT_TYPES) or re.search(r"[=)]", masked[m.end() : stop.start()].replace("=>", "").replace(")", "", masked[m.end() : stop.start()].count("("))):
            continue
        block = stop.group() == "{"
        if m["space"]:
            yield None, f"namespace:{m['path']}", "", m.start(), stop.start(), closing[stop.start()] + 1 if block else len(masked)
            continue
        scope = None if m["kind"] == "enum" else f"{m['kind']}:{m['name']}"
        if scope and block:
            types[stop.start()] = m["name"]
        yield m["kind"], scope, m["name"], m.start(), stop.start() if block else None, closing[stop.start()] + 1 if block else stop.end()
    owner, opened = {}, []
    for at, c in enumerate(masked):
        if c == "{":
            opened.append(at)
        elif c == "}":
            opened.pop()
        elif c == "(":
            owner[at] = opened[-1] if opened else None
    for m in _SHARP_METHOD.finditer(masked):
        home = types.get(owner.get(m.end()))
        if home is None or m["name"] in _NOT_TYPES or (m["type"] and set(re.findall(r"\w+", m["type"])[:1]) & _NOT_TYPES):
            continue
        if re.search(r"(?:\bdelegate|\boperator|[=~.,(])\s*$", masked[: m.start()]) or (m["type"] is None and m["name"] != home):
            continue
        stop = re.compile(r"=>|[{;=]").search(masked, closing[m.end()])
        if not stop or stop.group() == "=":
            continue
        start = m.start() + len(m["whole"]) - len(m["whole"].lstrip())
        kind = "method" if m["type"] else "constructor"
        if stop.group() == "{":
            yield kind, None, m["name"], start, stop.start(), closing[stop.start()] + 1
        elif stop.group() == ";":
            yield kind, None, m["name"], start, None, stop.end()
        else:
            at = stop.end()
            while masked[at] != ";":
                at = closing[at] + 1 if masked[at] in "([{" else at + 1
            yield kind, None, m["name"], start, stop.start(), at + 1


def declarations(text: str, language: str) -> list[tuple] | None:
    """(kind, scope, name, signature, body, source, byte start, byte end) in
    order of place; None if the source is not supported. A declaration without a
    body has no signature either."""
    if language not in LANGUAGES.values() or len(text.encode()) > MOST_BYTES:
        return None
    masked = _masked(text, language)
    closing = _brackets(masked)
    if closing is None:
        return None
    try:
        found = list((_rust if language == "rust" else _sharp)(masked, closing))
    except IndexError:  # a member that nothing ends
        return None
    out, scopes, at, size = [], [], 0, 0
    for kind, scope, name, start, body, end in sorted(found, key=lambda x: (x[3], -x[5])):
        while scopes and scopes[-1][1] <= start:
            scopes.pop()
        if kind:
            size += len(text[at:start].encode())
            at = start
            whole = text[start:end]
            inner = "" if body is None else text[body:end] if text[body] == "{" else text[body:end].rstrip(";").rstrip()
            signature = "" if body is None else text[start:body].rstrip()
            out.append((kind, "/".join(s for s, _ in scopes), name, signature, inner, whole, size, size + len(whole.encode())))
            if len(out) > MOST_SYMBOLS:
                return None
        if scope:
            scopes.append((scope, end))
    return out


SYMBOL = "array<struct<kind:string,scope:string,name:string,signature:string,body:string,source:string,byte_start:int,byte_end:int>>"
declarations_col = vectorized(declarations, SYMBOL)


def parse_symbols(files: DataFrame, keys: tuple[str, ...] = ("path",), text: str = "content") -> tuple[DataFrame, DataFrame]:
    """(symbols, files): symbols has a row a declaration; files tells which are supported.

    Each distinct content is parsed once (see grammar.py), and met again by its hash."""
    from ..functions.text import extension
    from .grammar import declared

    e = extension(F.col("path"))
    language = F.when(e == "rs", "rust").when(e == "cs", "csharp")
    content = F.col(text).cast("string")
    code = files.select(*keys, content.alias("text"), language.alias("language")).where(F.col("language").isNotNull())
    code = code.withColumn("cid", F.concat(F.coalesce(F.sha2("text", 256), F.lit("none")), "language"))
    # Written, since declared() reads the contents three times, and each time their texts would be hashed and shuffled.
    symbols, told = declared(saved(code.select("cid", "language", "text").dropDuplicates(["cid"])))
    code = code.select(*keys, "language", "cid")
    return code.join(symbols, "cid").drop("cid"), code.join(told, "cid").drop("cid")


def _single(df: DataFrame, on: list[str]) -> DataFrame:
    return df.join(df.groupBy(*on).count().where("count = 1").drop("count"), on, "left_semi")


def ast_diff(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """(keys, change, kind, before_name, after_name, byte ranges) of two versions
    of files: modify by identity, then rename or move by body, then add and delete."""
    k = list(keys)
    before, after = saved(before), saved(after)
    ident = [*k, "kind", "scope", "name"]
    cols = lambda df, side: df.select(*k, "kind", *[F.col(c).alias(f"{side}_{c}") for c in ("scope", "name", "body", "source", "byte_start", "byte_end")])
    one = lambda df, side: cols(_single(df, ident), side).withColumns({"scope": F.col(f"{side}_scope"), "name": F.col(f"{side}_name")})
    same = one(before, "before").join(one(after, "after"), ident)
    same = saved(same)
    out = ["change", "kind", "before_name", "after_name", "before_byte_start", "before_byte_end", "after_byte_start", "after_byte_end"]
    modified = same.where("before_source <> after_source").withColumn("change", F.lit("modify")).select(*k, *out)
    used_b = same.select(*k, "kind", F.col("before_byte_start").alias("byte_start"))
    used_a = same.select(*k, "kind", F.col("after_byte_start").alias("byte_start"))
    left, right = before.join(used_b, [*k, "kind", "byte_start"], "left_anti"), after.join(used_a, [*k, "kind", "byte_start"], "left_anti")
    left, right = saved(left), saved(right)
    body = [*k, "kind", "body"]
    moved = cols(_single(left.where(meaningful_body(F.col("body"))), body), "before").withColumn("body", F.col("before_body")).join(cols(_single(right.where(meaningful_body(F.col("body"))), body), "after").withColumn("body", F.col("after_body")), body)
    moved = moved.where((F.col("before_scope") != F.col("after_scope")) | (F.col("before_name") != F.col("after_name")))
    moved = moved.withColumn("change", F.when(F.col("before_scope") == F.col("after_scope"), "rename").otherwise("move")).select(*k, *out)
    moved = saved(moved)
    none_s, none_i = F.lit(None).cast("string"), F.lit(None).cast("int")
    gone = left.join(moved.select(*k, "kind", F.col("before_byte_start").alias("byte_start")), [*k, "kind", "byte_start"], "left_anti")
    new = right.join(moved.select(*k, "kind", F.col("after_byte_start").alias("byte_start")), [*k, "kind", "byte_start"], "left_anti")
    deleted = gone.select(*k, F.lit("delete").alias("change"), "kind", F.col("name").alias("before_name"), none_s.alias("after_name"), F.col("byte_start").alias("before_byte_start"), F.col("byte_end").alias("before_byte_end"), none_i.alias("after_byte_start"), none_i.alias("after_byte_end"))
    added = new.select(*k, F.lit("add").alias("change"), "kind", none_s.alias("before_name"), F.col("name").alias("after_name"), none_i.alias("before_byte_start"), none_i.alias("before_byte_end"), F.col("byte_start").alias("after_byte_start"), F.col("byte_end").alias("after_byte_end"))
    return modified.unionByName(moved).unionByName(deleted).unionByName(added)


def symbol_moves(before: DataFrame, after: DataFrame, ledger: DataFrame) -> DataFrame:
    """(before_path, after_path, kind, before_name, after_name, how, permille) of
    functions and methods that went to another file: exact, edited with the same
    signature, or renamed with a nearly equal body."""
    eligible = F.col("kind").isin("function", "method") & (F.length("signature") > 0) & meaningful_body(F.col("body"))
    renamed = ledger.where("kind = 'renamed'")
    b = before.where(eligible).join(renamed.select(F.col("before_path").alias("path")), "path", "left_anti")
    a = after.where(eligible).join(renamed.select(F.col("after_path").alias("path")), "path", "left_anti")
    b, a = saved(b), saved(a)
    stay = ["path", "language", "kind", "scope", "name"]
    left, right = b.join(a.select(stay).distinct(), stay, "left_anti"), a.join(b.select(stay).distinct(), stay, "left_anti")
    sid = F.concat_ws("\u0001", "path", "byte_start")
    left, right = saved(left.withColumn("before_id", sid)), saved(right.withColumn("after_id", sid))

    def named(pairs: DataFrame, how: str) -> DataFrame:
        x = left.select("before_id", F.col("path").alias("before_path"), "kind", F.col("name").alias("before_name"), F.col("byte_start").alias("before_start"), F.col("byte_end").alias("before_end"))
        y = right.select("after_id", F.col("path").alias("after_path"), F.col("name").alias("after_name"), F.col("byte_start").alias("after_start"), F.col("byte_end").alias("after_end"))
        return saved(pairs.join(x, "before_id").join(y, "after_id").where("before_path <> after_path").withColumn("how", F.lit(how)))

    on = ["language", "kind", "name", "source"]
    exact = named(_single(left, on).select(*on, "before_id").join(_single(right, on).select(*on, "after_id"), on).select("before_id", "after_id", F.lit(1000).alias("permille")), "exact")
    rest_l, rest_r = saved(left.join(exact, "before_id", "left_anti")), saved(right.join(exact, "after_id", "left_anti"))
    on = ["language", "kind", "signature"]
    edited = named(dice_pairs(_single(rest_l, on), _single(rest_r, on), tuple(on), "before_id", "after_id").select("before_id", "after_id", "permille"), "edited")
    rest_l, rest_r = saved(rest_l.join(edited, "before_id", "left_anti")), saved(rest_r.join(edited, "after_id", "left_anti"))
    rich = (F.size(code_tokens(F.col("body"))) >= 20) & (F.size(F.array_distinct(code_tokens(F.col("body")))) >= 12)
    loose = dice_pairs(rest_l.where(rich), rest_r.where(rich), ("language", "kind"), "before_id", "after_id", least=950, tokens=20, distinct=12)
    about = lambda d, side: d.select(f"{side}_id", *[F.col(c).alias(f"{side}_{c}") for c in ("path", "name", "signature")])
    same = lambda c: F.col(f"before_{c}") == F.col(f"after_{c}")
    loose = loose.select("before_id", "after_id", "permille").join(about(rest_l, "before"), "before_id").join(about(rest_r, "after"), "after_id")
    loose = saved(loose.where(~same("path") & ~(same("name") & same("signature"))))
    alone = lambda d, own, other: d.groupBy(own).agg(F.count("*").alias("n"), F.max(other).alias(other), F.max("permille").alias("permille")).where("n = 1").drop("n")
    # The only partner of the old one, claimed by no other, and the only one of the new one with neither its name nor its signature.
    rivals = loose.where(~same("name") & ~same("signature")).groupBy("after_id").count().where("count = 1")
    loose = named(alone(alone(loose, "before_id", "after_id"), "after_id", "before_id").join(rivals, "after_id", "left_semi").select("before_id", "after_id", "permille"), "renamed")
    return outermost(exact.unionByName(edited).unionByName(loose)).select("before_path", "after_path", "kind", "before_name", "after_name", "how", "permille")


def outermost(moves: DataFrame) -> DataFrame:
    """Moves that are not inside another move between the same two files."""
    m, o = moves.alias("m"), moves.alias("o")
    inside = (F.col("m.before_path") == F.col("o.before_path")) & (F.col("m.after_path") == F.col("o.after_path")) & (F.col("o.before_start") <= F.col("m.before_start")) & (F.col("o.before_end") >= F.col("m.before_end")) & (F.col("o.before_end") - F.col("o.before_start") > F.col("m.before_end") - F.col("m.before_start"))
    return m.join(o, inside, "left_anti")


def scan_counters(files: DataFrame, moves: DataFrame, most: int | None = None) -> DataFrame:
    """One row (analyzed, skipped, n_moves, stage_skipped): how many files were parsed,
    how many were not, how many moves were found, and whether more files than `most`
    ended a scan. files is the second table of parse_symbols()."""
    one = lambda a, s, m: (a.cast("long").alias("analyzed"), s.cast("long").alias("skipped"), m.cast("long").alias("n_moves"))
    zero, ok = F.lit(0), F.col("supported").cast("int")
    each = files.select(*one(ok, 1 - ok, zero)).unionByName(moves.select(*one(zero, zero, F.lit(1))))
    n = each.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("analyzed", "skipped", "n_moves")])
    return n.withColumn("stage_skipped", F.lit(False) if most is None else F.col("analyzed") + F.col("skipped") > most)
