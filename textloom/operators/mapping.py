"""From matches, hunks and declarations to events, movements, excerpts and messages.

Everything is an equi-join with a range condition, a window or an expression;
only the words around a marker come from a kernel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import LEXERS, compact, utf16_offsets
from ..functions.vectorized import vectorized
from .ledger import event_id

# ---------------------------------------------------------------- tables


def table_moves(pairs: DataFrame, keys: tuple[str, ...] = ("comparison_id",)) -> DataFrame:
    """(keys, old_ix, new_ix, reason) of moved tables and rows, at the first cell of
    each of their rows.

    pairs: matched units (keys, old_ix, new_ix, old_table, old_row, old_col,
    new_table, new_row, new_col), the last six null beside tables. A table moved
    if its first cell stands on the other side of a matched text, or of a cell of
    another table, than before; else a row moved if it crosses another row."""
    k, tables = list(keys), ["old_table", "new_table"]
    before = Window.partitionBy(*k).orderBy("old_ix").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*k).orderBy("old_ix").rowsBetween(1, Window.unboundedFollowing)
    text = F.when(F.col("old_table").isNull() & F.col("new_table").isNull(), F.col("new_ix"))
    seen = pairs.withColumn("__high", F.max(text).over(before)).withColumn("__low", F.min(text).over(after))
    cells = seen.where("old_table IS NOT NULL AND new_table IS NOT NULL")
    first = cells.groupBy(*k, *tables).agg(F.min(F.struct("old_ix", "new_ix", "__high", "__low")).alias("f")).select(*k, *tables, "f.*")
    across_text = F.coalesce(F.col("__high") > F.col("new_ix"), F.lit(False)) | F.coalesce(F.col("__low") < F.col("new_ix"), F.lit(False))
    a, b = first.alias("a"), cells.alias("b")
    crossed = (F.col("a.old_table") != F.col("b.old_table")) & (F.col("a.new_table") != F.col("b.new_table")) & ((F.col("a.old_ix") < F.col("b.old_ix")) != (F.col("a.new_ix") < F.col("b.new_ix")))
    on = crossed
    for c in k:
        on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    moved = first.where(across_text).select(*k, *tables).unionByName(a.join(b, on, "left_semi").select(*k, *tables)).distinct().withColumn("__moved", F.lit(True))
    rows = cells.groupBy(*k, *tables, "old_row", "new_row").agg(F.min(F.struct("old_col", "old_ix", "new_ix")).alias("f")).select(*k, *tables, "old_row", "new_row", "f.old_ix", "f.new_ix")
    w = Window.partitionBy(*k, *tables).orderBy("old_row")
    row_high, row_low = F.max("new_row").over(w.rangeBetween(Window.unboundedPreceding, -1)), F.min("new_row").over(w.rangeBetween(1, Window.unboundedFollowing))
    crossing = F.coalesce(row_high > F.col("new_row"), F.lit(False)) | F.coalesce(row_low < F.col("new_row"), F.lit(False))
    told = rows.withColumn("__row", crossing).join(moved, [*k, *tables], "left")
    reason = F.when(F.col("__moved"), "table moved").when(F.col("__row"), "row moved")
    return told.withColumn("reason", reason).where("reason IS NOT NULL").select(*k, "old_ix", "new_ix", "reason")


# ---------------------------------------------------------------- code


def lines_of(points: DataFrame, lines: DataFrame, keys: tuple[str, ...] = ("path",), at: str = "byte") -> DataFrame:
    """points (keys, byte, ...) with line_no, the line that holds the byte; a byte at
    the end of the text is on its last line. lines: review.line_offsets()."""
    k = list(keys)
    last = lines.groupBy(*k).agg(F.max("line_no").alias("__last"), F.max("byte_end").alias("__end"))
    p, ls = points.alias("p"), lines.alias("l")
    on = (F.col(f"p.{at}") >= F.col("l.byte_start")) & (F.col(f"p.{at}") < F.col("l.byte_end"))
    for c in k:
        on = on & (F.col(f"p.{c}") == F.col(f"l.{c}"))
    met = p.join(ls, on, "left").select("p.*", "l.line_no").join(last, k, "left")
    line = F.coalesce("line_no", F.when(F.col(at) == F.col("__end"), F.col("__last")))
    return met.withColumn("line_no", line).drop("__last", "__end")


def symbol_events(changes: DataFrame, before: DataFrame, after: DataFrame, hunks: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """(keys, ord, change, kind, name, side, line_no, event_id): declaration changes
    as events, numbered after the line hunks of their file. A deletion stands on a
    line of the old file, all others on one of the new. changes: symbols.ast_diff();
    before and after: review.line_offsets()."""
    k = list(keys)
    gone = F.col("change") == "delete"
    named = changes.withColumn("side", F.when(gone, "before").otherwise("after")).withColumn("name", F.when(gone, F.col("before_name")).otherwise(F.col("after_name"))).withColumn("byte", F.when(gone, F.col("before_byte_start")).otherwise(F.col("after_byte_start")))
    placed = lines_of(named.where(gone), before, keys).unionByName(lines_of(named.where(~gone), after, keys))
    many = hunks.groupBy(*k).agg(F.count("*").alias("__n"))
    nth = F.row_number().over(Window.partitionBy(*k).orderBy("line_no", "byte", "change", "name"))
    out = placed.join(many, k, "left").withColumn("ord", F.coalesce("__n", F.lit(0)) + nth)
    return out.withColumn("event_id", event_id(*[F.col(c) for c in (*k, "change", "kind", "before_name", "after_name", "ord")])).select(*k, "ord", "change", "kind", "name", "side", "line_no", "event_id")


def folder_events(files: DataFrame, moves: DataFrame) -> DataFrame:
    """(kind, before_path, after_path, location, evidence, event_id): the events of a
    file ledger, none replaced, and below them those of declarations that moved
    between files (symbols.symbol_moves())."""
    cols = ["kind", "before_path", "after_path", "location", "evidence"]
    of_files = files.select("kind", "before_path", "after_path", F.lit("file").alias("location"), F.when(F.col("kind") == "renamed", "equal content, unique on both sides").otherwise("content hash").alias("evidence"))
    of_symbols = moves.select(F.lit("moved").alias("kind"), "before_path", "after_path", F.concat_ws(" -> ", F.col("before_name"), F.when(F.col("before_name") != F.col("after_name"), F.col("after_name"))).alias("location"), F.concat(F.col("how"), F.lit(", "), F.col("permille"), F.lit(" permille")).alias("evidence"))
    return of_files.unionByName(of_symbols).withColumn("event_id", event_id(*map(F.col, cols)))


def excerpts(lines: DataFrame, hunks: DataFrame, keys: tuple[str, ...] = ("pair_id",), side: str = "after") -> DataFrame:
    """lines (keys, line_no, ...) with hunk_ord, the hunk that a line belongs to
    (null: none), by a sweep over hunk edges instead of a join of ranges."""
    k = list(keys)
    spans = hunks.where(F.col(f"{side}_end") > F.col(f"{side}_start")).select(*k, F.col(f"{side}_start").alias("line_no"), F.struct(F.col("ord"), F.col(f"{side}_end").alias("end")).alias("__h"))
    w = Window.partitionBy(*k).orderBy("line_no", F.col("__line").asc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cols = [c for c in lines.columns if c not in k and c != "line_no"]
    both = lines.withColumn("__h", F.lit(None).cast(spans.schema["__h"].dataType)).withColumn("__line", F.lit(1)).unionByName(spans.withColumn("__line", F.lit(0)).withColumns({c: F.lit(None).cast(lines.schema[c].dataType) for c in cols}))
    held = both.withColumn("__last", F.last("__h", ignorenulls=True).over(w)).where("__line = 1")
    return held.withColumn("hunk_ord", F.when(F.col("line_no") < F.col("__last.end"), F.col("__last.ord"))).drop("__h", "__line", "__last")


def excerpt_text(c: Column, most: int = 160) -> Column:
    """The first line of a text, cut to `most` characters with an ellipsis."""
    line = F.regexp_extract(c, r"^([^\r\n]*)", 1)
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most - 1), F.lit("…"))).otherwise(line)


# ---------------------------------------------------------------- markers and messages


def boundary_tokens(text: str, start: int, end: int) -> tuple[str, str]:
    """The last token before and the first one after a range of UTF-16 units."""
    u = utf16_offsets(text)
    places = {x: i for i, x in enumerate(u)}
    a, b = places.get(start, 0), places.get(end, len(text))
    before, after = LEXERS["boundary"].findall(text[:a]), LEXERS["boundary"].findall(text[b:])
    return (before[-1] if before else "", after[0] if after else "")


boundary_tokens_col = vectorized(lambda text, start, end: list(boundary_tokens(text, int(start), int(end))), "array<string>")


def label_change(old: Column, new: Column) -> Column:
    """A paragraph's list label as a change: struct(kind, old, new), null if equal.
    A label that only the new paragraph has is an insertion; one that it lacks or
    has otherwise is kept as the original label."""
    a, b = F.coalesce(old, F.lit("")), F.coalesce(new, F.lit(""))
    kind = F.when((a == "") & (b != ""), "insert").when(a != b, "original")
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), a.alias("old"), b.alias("new")))


def concrete_messages(messages: DataFrame, keys: tuple[str, ...] = ("comparison_id", "row_id")) -> DataFrame:
    """Messages (keys, ord, code, old, ...) worth showing: concrete ones where a row
    has any, else its status; a status that only says `changed` is what the
    markers show already."""
    concrete = F.col("code") != "status"
    has = F.max(concrete).over(Window.partitionBy(*keys))
    return messages.withColumn("__any", has).where(concrete | (~F.col("__any") & (F.col("old") != "changed"))).drop("__any")


def row_summaries(markers: DataFrame, messages: DataFrame, keys: tuple[str, ...] = ("comparison_id", "row_id")) -> DataFrame:
    """(keys, first_place, messages): the first marked place of a row and its
    distinct message texts in order."""
    place = markers.groupBy(*keys).agg(F.min(F.least("old_start", "new_start")).alias("first_place"))
    said = messages.groupBy(*keys).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", message("en").alias("m")))), lambda x: x["m"])).alias("messages"))
    return place.join(said, list(keys), "full").withColumn("messages", F.coalesce("messages", F.array().cast("array<string>")))


#: Message texts by code and language, our own wording. {0} and {1} are quoted document text.
MESSAGES = {
    "en": {"status": "Status: {0}", "renumbered": "Renumbered: {0} -> {1}", "retitled": "Title changed: {0} -> {1}", "structure": "List structure changed: {0} -> {1}", "item moved": "Item moved: {0} -> {1}", "item level": "Item level changed: {0} -> {1}", "item notation": "Item label changed: {0} -> {1}", "cell merge": "Cell merge changed: {0} -> {1}", "cell paragraphs": "Paragraphs in cell: {0} -> {1}", "table moved": "Table moved", "row moved": "Table row moved"},
    "de": {"status": "Status: {0}", "renumbered": "Neu nummeriert: {0} -> {1}", "retitled": "Titel geändert: {0} -> {1}", "structure": "Gliederung geändert: {0} -> {1}", "item moved": "Punkt verschoben: {0} -> {1}", "item level": "Ebene des Punkts geändert: {0} -> {1}", "item notation": "Bezeichnung des Punkts geändert: {0} -> {1}", "cell merge": "Zellverbund geändert: {0} -> {1}", "cell paragraphs": "Absätze der Zelle: {0} -> {1}", "table moved": "Tabelle verschoben", "row moved": "Tabellenzeile verschoben"},
}


def message(language: str = "en", code: str = "code", old: str = "old", new: str = "new") -> Column:
    """A typed message in a language; document text in it is left as it is."""
    out = F.lit(None).cast("string")
    for name, text in MESSAGES[language].items():
        parts, shown = text.replace("{1}", "\0{1}\0").replace("{0}", "\0{0}\0").split("\0"), {"{0}": old, "{1}": new}
        out = F.when(F.col(code) == name, F.concat(*[F.coalesce(F.col(shown[p]), F.lit("")) if p in shown else F.lit(p) for p in parts if p])).otherwise(out)
    return out


def renumbered(markers: DataFrame, keys: tuple[str, ...] = ("comparison_id",)) -> DataFrame:
    """Markers numbered through a whole comparison, in the order of rows and of
    their numbers in a row."""
    return markers.withColumn("num", F.row_number().over(Window.partitionBy(*keys).orderBy("row_id", "num")))


def clipped(lines: DataFrame, markers: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, line_no, kind, start, end): marker ranges inside each line, counted
    from the line's start. lines (keys, line_no, start, end), markers (keys, kind,
    start, end)."""
    a, b = lines.alias("a"), markers.alias("b")
    on = (F.col("b.start") < F.col("a.end")) & (F.col("b.end") > F.col("a.start"))
    for c in keys:
        on = on & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    low, high = F.greatest("a.start", "b.start") - F.col("a.start"), F.least("a.end", "b.end") - F.col("a.start")
    return a.join(b, on).select(*[F.col(f"a.{c}") for c in keys], "a.line_no", "b.kind", low.alias("start"), high.alias("end"))


def anchored(anchors: DataFrame, rows: DataFrame, keys: tuple[str, ...] = ("comparison_id",), anchor: str = "anchor", text: str = "text", order: str = "row_id") -> DataFrame:
    """anchors (keys, anchor) with the first row whose text holds the anchor, as it
    is or, if none does, without white space; null if no row does."""
    k = list(keys)
    a, r = anchors.withColumn("__id", F.monotonically_increasing_id()), rows.select(*k, F.col(order).alias("__row"), F.col(text).alias("__text"))
    exact, loose = F.col("__text").contains(F.col(anchor)), compact(F.col("__text")).contains(compact(F.col(anchor)))
    rank = F.when(exact, 0).when(loose, 1)
    best = a.join(r, k).withColumn("__rank", rank).where("__rank IS NOT NULL").groupBy("__id").agg(F.min(F.struct("__rank", "__row")).alias("__b"))
    return a.join(best, "__id", "left").withColumn(order, F.col("__b.__row")).drop("__id", "__b")


def units_of_documents(units: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, n_units, and how many of each kind)."""
    kinds = ("article", "section", "block", "preamble", "cell")
    return units.groupBy(*keys).agg(F.count("*").alias("n_units"), *[F.count_if(F.col("kind") == x).alias(f"n_{x}") for x in kinds])


def page(rows: DataFrame, order: tuple[str, ...], number: int, size: int = 250) -> DataFrame:
    """One page of rows (from 0 on) in an order that must be total."""
    return rows.orderBy(*order).offset(number * size).limit(size)
