"""Change markers, their order and numbers, typed events and review rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse_spaces, compact, punctuation_only, utf16_length
from .diff import review_events_col, segments_col
from .ledger import event_id

KINDS = ("added", "deleted", "modified", "moved", "renamed", "renumbered", "reformatted", "structure")


def compare_pairs(pairs: DataFrame, keys: tuple[str, ...] = ("pair_id",), old: str = "old", new: str = "new", part: str = "body", punctuation: bool = True) -> DataFrame:
    """Markers (keys, part, hunk_order, kind, offsets, texts) of pairs of texts; a
    missing side is one whole insertion or deletion, made without a UDF."""
    a, b = F.col(old), F.col(new)
    k = list(keys)
    whole = pairs.where((a.isNull() | (a == "")) != (b.isNull() | (b == "")))
    zero, text = F.lit(0), lambda c: F.coalesce(c, F.lit(""))
    missing = whole.select(*k, F.lit(part).alias("part"), zero.alias("hunk_order"), F.when(text(a) == "", "insert").otherwise("delete").alias("kind"), zero.alias("old_start"), F.coalesce(utf16_length(a), zero).alias("old_end"), zero.alias("new_start"), F.coalesce(utf16_length(b), zero).alias("new_end"), text(a).alias("old_text"), text(b).alias("new_text"))
    both = pairs.where((text(a) != "") & (text(b) != "") & (a != b))
    made = both.select(*k, F.lit(part).alias("part"), F.posexplode(review_events_col(a, b)).alias("hunk_order", "e")).select(*k, "part", "hunk_order", "e.*")
    found = missing.unionByName(made)
    return found if punctuation else found.where(~(punctuation_only(F.concat("old_text", "new_text"))))


def numbered(markers: DataFrame, row: tuple[str, ...] = ("comparison_id", "row_id"), order: tuple[str, ...] = ("pair", "part_order", "item_order", "hunk_order", "old_start")) -> DataFrame:
    """Markers with their number in a row: by pair, header before body, item, hunk, place."""
    part = F.when(F.col("part") == "header", 0).otherwise(1)
    return markers.withColumn("part_order", part).withColumn("num", F.row_number().over(Window.partitionBy(*row).orderBy(*order))).drop("part_order")


def sequenced(changes: DataFrame, keys: tuple[str, ...] = ("comparison_id",)) -> DataFrame:
    """All change types in document order: row, position, priority, given order."""
    return changes.withColumn("seq", F.row_number().over(Window.partitionBy(*keys).orderBy("row_id", "position", "priority", "stable_ord")))


def ensure_numbered(markers: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Markers without a number get the ones after the largest; ids stay."""
    w = Window.partitionBy(*keys)
    nth = F.row_number().over(Window.partitionBy(*keys, F.col("num").isNull()).orderBy("stable_ord"))
    return markers.withColumn("num", F.coalesce("num", F.coalesce(F.max("num").over(w), F.lit(0)) + nth))


def changed_rows(rows: DataFrame, markers: DataFrame, keys: tuple[str, ...] = ("comparison_id", "row_id")) -> DataFrame:
    count = markers.groupBy(*keys).agg(F.count("*").alias("n_markers"))
    return rows.join(count, list(keys), "left").withColumn("n_markers", F.coalesce("n_markers", F.lit(0))).withColumn("changed", F.col("n_markers") > 0)


def missing_units(units: DataFrame, matches: DataFrame, keys: tuple[str, ...] = ("comparison_id",), side: str = "old") -> DataFrame:
    """(keys, unit_ix, part, kind, text): whole headers and bodies of the units of
    one side that have no match; empty parts give no marker."""
    kind = F.lit("delete" if side == "old" else "insert")
    k = [*keys, "unit_ix"]
    lone = units.join(matches.select(*keys, F.col(f"{side}_ix").alias("unit_ix")), k, "left_anti")
    both = F.explode(F.array(F.struct(F.lit("header").alias("part"), F.col("header").alias("text")), F.struct(F.lit("body").alias("part"), F.col("body").alias("text"))))
    return lone.select(*k, both.alias("p")).select(*k, "p.part", kind.alias("kind"), "p.text").where(F.length(F.trim("text")) > 0)


def collapsed_wrappers(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("comparison_id", "unit_ix")) -> DataFrame:
    """(keys, part_ix) of a list item that was taken out while its own items moved
    one level up and all others stayed. old and new are (keys, part_ix, level,
    core); a unit's parts are few (a parser's bound), so they meet as arrays."""
    side = lambda df, name: df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("part_ix", "level", "core"))).alias(name))
    both = side(old, "o").join(side(new, "n"), list(keys)).where((F.size("n") > 0) & (F.size("o") == F.size("n") + 1))
    same = F.expr("transform(sequence(0, size(n) - 1), i -> o[i].core <=> n[i].core AND o[i].level = n[i].level)")
    at = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size("n")).cast("int")
    both = both.withColumn("at", at).withColumn("own", F.expr("get(o, at).level"))
    # Items below the wrapper: from the one after it up to the next one that is not deeper.
    stop = F.expr("coalesce(get(filter(sequence(at, size(n)), i -> i > at AND o[i].level <= own), 0), size(n) + 1)")
    both = both.withColumn("stop", stop).where("stop > at + 1")
    rest = F.expr("forall(sequence(at, size(n) - 1), i -> o[i + 1].core <=> n[i].core AND n[i].level = o[i + 1].level - IF(i + 1 < stop, 1, 0))")
    return both.where(rest).select(*keys, F.expr("get(o, at).part_ix").alias("part_ix"))


def search(rows: DataFrame, query: str, text: str = "text") -> DataFrame:
    """Rows that hold the query, white space collapsed or left out, any case."""
    q = " ".join(query.lower().split())
    norm = F.lower(collapse_spaces(F.col(text)))
    return rows.where(norm.contains(q) | compact(F.col(text)).contains(q.replace(" ", "")))


def section_labels(rows: DataFrame, keys: tuple[str, ...] = ("comparison_id",), order: str = "row_id") -> DataFrame:
    """The section of a row where it differs from the row before."""
    before = F.lag("section").over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("section_label", F.when(F.coalesce(before, F.lit("")) != F.coalesce("section", F.lit("")), F.col("section")))


def pair_plan(n: int, base: int = 0, first_to_last: bool = False) -> list[tuple[int, int]]:
    """Version pairs to compare: two from the base on; three in a row, A to C on demand."""
    if n == 2:
        return [(base, 1 - base)]
    return [(i, i + 1) for i in range(n - 1)] + ([(0, n - 1)] if first_to_last and n > 2 else [])


def classify(matches: DataFrame) -> DataFrame:
    """matches (…, mode, old_number, new_number, old_title, new_title, old_section,
    new_section) with typed flags and the statuses in order of weight."""
    neq = lambda a, b: F.coalesce(a, F.lit("")) != F.coalesce(b, F.lit(""))
    flags = {"moved": F.col("mode") == "moved", "renumbered": neq(F.col("old_number"), F.col("new_number")), "retitled": neq(F.col("old_title"), F.col("new_title")), "resectioned": neq(F.col("old_section"), F.col("new_section"))}
    out = matches.withColumns(flags)
    return out.withColumn("statuses", F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in flags])))


def moved_rows(matches: DataFrame, keys: tuple[str, ...], old: str = "old_ix", new: str = "new_ix") -> DataFrame:
    """Matches out of order: some earlier one lands later, or a later one earlier,
    by running extremes instead of comparing all pairs."""
    w = Window.partitionBy(*keys).orderBy(old)
    before = F.max(new).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(new).over(w.rowsBetween(1, Window.unboundedFollowing))
    return matches.withColumn("crossed", F.coalesce(before > F.col(new), F.lit(False)) | F.coalesce(after < F.col(new), F.lit(False)))


def placements(markers: DataFrame) -> DataFrame:
    """Endpoint rows (doc, role, start, end) of markers; a body starts one unit
    after its header, even an empty one."""
    shift = lambda n: F.when(F.col("part") == "body", F.coalesce(n, F.lit(0)) + 1).otherwise(F.lit(0))
    ends = F.array(
        F.struct(F.lit("old").alias("doc"), F.when(F.col("kind") == "insert", "anchor").when(F.col("kind") == "delete", "delete").otherwise("change").alias("role"), (F.col("old_start") + shift(F.col("old_header"))).alias("start"), (F.col("old_end") + shift(F.col("old_header"))).alias("end")),
        F.struct(F.lit("new").alias("doc"), F.when(F.col("kind") == "delete", "anchor").when(F.col("kind") == "insert", "insert").otherwise("change").alias("role"), (F.col("new_start") + shift(F.col("new_header"))).alias("start"), (F.col("new_end") + shift(F.col("new_header"))).alias("end")),
    )
    return markers.withColumn("p", F.explode(ends)).select("*", "p.*").drop("p")


def line_offsets(files: DataFrame, keys: tuple[str, ...] = ("path",), text: str = "content") -> DataFrame:
    """(keys, line_no, line, byte_start, byte_end, utf16_start, utf16_end) of each line."""
    from ..functions.text import code_lines

    lines = files.select(*keys, F.posexplode(code_lines(F.col(text))).alias("line_no", "line"))
    w = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = lambda c: F.sum(c).over(w)
    size = {"byte": F.octet_length("line"), "utf16": utf16_length(F.col("line"))}
    return lines.select("*", *[x for n, s in size.items() for x in ((run(s) - s).cast("int").alias(f"{n}_start"), run(s).cast("int").alias(f"{n}_end"))])


def located(hunks: DataFrame, before: DataFrame, after: DataFrame, keys: tuple[str, ...] = ("pair_id",)) -> DataFrame:
    """Line hunks as events with byte and UTF-16 ranges; before and after are
    line_offsets(). Lines of a range are joined and aggregated, not looked up."""
    k = list(keys)

    def ranges(lines: DataFrame, side: str) -> DataFrame:
        touched = hunks.select(*k, "ord", F.explode(F.sequence(F.col(f"{side}_start"), F.greatest(F.col(f"{side}_start"), F.col(f"{side}_end") - 1))).alias("line_no"), (F.col(f"{side}_end") > F.col(f"{side}_start")).alias("filled"))
        met = touched.join(lines, [*k, "line_no"], "left")
        end = lambda u: F.when(F.first("filled"), F.max(f"{u}_end")).otherwise(F.min(f"{u}_start"))
        return met.groupBy(*k, "ord").agg(*[x for u in ("byte", "utf16") for x in (F.min(f"{u}_start").alias(f"{side}_{u}_start"), end(u).alias(f"{side}_{u}_end"))])

    out = hunks.join(ranges(before, "before"), [*k, "ord"]).join(ranges(after, "after"), [*k, "ord"])
    return out.withColumn("event_id", event_id(*[F.col(c) for c in (*k, "kind", "before_start", "before_end", "after_start", "after_end", "ord")]))


def change_events(ledger: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """A file ledger as unified change events with ids; keys tell ledgers apart."""
    kind = F.col("kind")
    described = ledger.select(*keys, kind.alias("kind"), F.struct(F.col("before_path").alias("path"), F.lit("file").alias("location")).alias("before"), F.struct(F.col("after_path").alias("path"), F.lit("file").alias("location")).alias("after"), F.concat_ws(" -> ", "before_path", F.when(kind == "renamed", F.col("after_path"))).alias("description"), F.when(kind == "renamed", "equal content, unique on both sides").otherwise("content hash").alias("evidence"))
    return described.withColumn("event_id", event_id(kind, F.col("before"), F.col("after"), F.col("description"), F.col("evidence"), *map(F.col, keys)))


def marked_segments(rows: DataFrame, text: str = "text", deleted: str = "deleted", inserted: str = "inserted") -> DataFrame:
    """Rows with styled runs; deleted and inserted are arrays of (start, end)."""
    span = "array<struct<start:int,end:int>>"
    pairs = lambda c: F.transform(F.col(c).cast(span), lambda s: F.array(s["start"], s["end"]))
    return rows.withColumn("segments", segments_col(F.col(text), pairs(deleted), pairs(inserted)))


def messages_on_lines(lines: DataFrame, markers: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, line_no, messages): markers that overlap a line's range; an empty
    range counts at both of its ends."""
    on = [lines[c] == markers[c] for c in keys]
    meets = (markers["start"] < lines["end"]) & (markers["end"] > lines["start"])
    touches = (markers["start"] == markers["end"]) & markers["start"].between(lines["start"], lines["end"])
    cond = (meets | touches) & F.lit(True)
    for c in on:
        cond = cond & c
    met = lines.join(markers, cond).select(*[lines[c] for c in keys], lines["line_no"], markers["num"], markers["message"])
    return met.groupBy(*keys, "line_no").agg(F.transform(F.sort_array(F.collect_list(F.struct("num", "message"))), lambda m: m["message"]).alias("messages"))


def row_height(text: Column, width: int, heading: Column | None = None) -> Column:
    """Estimated height in points of a cell: 15 a line and 6, at most 409, at least 24
    where heading is true; wide characters count double."""
    units = lambda line: F.length(line) + F.length(F.regexp_replace(line, r"[\x00-\x7F]", ""))
    lines = F.aggregate(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.greatest(F.lit(1), F.ceil(units(x) / width).cast("int"))), F.lit(0), lambda a, b: a + b)
    high = F.least(F.lit(409), lines * 15 + 6)
    return high if heading is None else F.when(heading, F.greatest(high, F.lit(24))).otherwise(high)
