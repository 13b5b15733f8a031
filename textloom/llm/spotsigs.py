"""SpotSigs document fingerprints, with DataFrame operations only.

A spot is a chain of CHAIN content words that follows a common word (anchor);
a text's fingerprint is the set of its spots (Theobald, Siddharth and Paepcke,
2008). A text is lower-cased, its runs of letters and digits are its words, the
start of the text counts as an anchor, and a text without any anchor word takes
every word as anchored, so that texts in other languages have spots as well.
Spots are kept as sorted sets of 64-bit hashes; the fingerprint's string form is
a hash of that set, so equal texts have equal strings.

similar() is the self-join: sets are partitioned by length, since a Jaccard
similarity of t needs lengths within the factor t; each set is indexed by its
rarest spots only (prefix filter), candidates share one, and the Jaccard
similarity is verified. Equal sets are one member before the join.

Defined cases: null and empty texts and texts without letters or digits have the
empty set, whose likeness is 1 to an empty set and 0 to others; repeated rows are
rows of their own; rows of equal ids follow each other by a hash of their texts;
with one row the next row is the row itself; null ids come last; other columns
don't matter, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

CHAIN = 3
#: Anchors: common words of English, French, German and Spanish, our own choice.
ANCHORS = """
the of and a an to in is it that for was on are as with be by this at from or have had not but
le la les de des du et un une que qui est en dans pour par sur il elle au ce se ne pas plus
der die das und den dem ein eine ist im zu von mit sich nicht auch auf für er sie es wird
el los las y una por con para su del al lo como más se no
""".split()


def _alternatives(words: set[str]) -> str:
    """A pattern for the words that shares their beginnings, so that a mismatch
    is seen at the first letter."""
    rest: dict[str, set[str]] = {}
    for w in words - {""}:
        rest.setdefault(w[0], set()).add(w[1:])
    if not rest:
        return ""
    found = "|".join(c + _alternatives(rest[c]) for c in sorted(rest))
    return f"(?:{found})" + "?" * ("" in words) if len(rest) > 1 or "" in words else found


_ANCHOR = _alternatives(set(ANCHORS))
#: Rows of one window of neighbours, and the most windows (then they grow).
NEIGHBOURS, MOST_RANGES = 512, 16_384


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spots(text: Column, chain: int = CHAIN) -> Column:
    """array<long>: the sorted set of a text's spot hashes."""
    words = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    # Each anchor word becomes a mark, so that the last mark of a run of anchors stands at the word that
    # follows it. One match for each anchor: a repeated group would recurse as deep as the run is long.
    marked = F.regexp_replace(words, rf"(?<= ){_ANCHOR} ", "\u0001")
    # The start of the text is an anchor; without any other every word is anchored.
    marked = _let(marked, lambda m: F.when(F.instr(m, "\u0001") > 0, F.concat(F.lit("\u0001"), F.ltrim(m))).otherwise(F.replace(m, F.lit(" "), F.lit(" \u0001"))))
    found = F.regexp_extract_all(marked, F.lit(rf"\x01(?=([^ \x01]+(?:[ \x01]+[^ \x01]+){{0,{chain - 1}}}))"), F.lit(1))
    # Without the marks a chain is the same words wherever anchors stood between them.
    return F.sort_array(F.array_distinct(F.transform(found, lambda s: F.xxhash64(F.replace(s, F.lit("\u0001"), F.lit(""))))))


def fingerprint(spots: Column) -> Column:
    """The string form of a spot set: 32 lowercase hex digits."""
    half = lambda seed: F.lpad(F.hex(F.xxhash64(F.lit(seed), spots)), 16, "0")
    return F.lower(F.concat(half(1), half(2)))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    whole = F.size(a) + F.size(b) - both
    return F.when(whole == 0, F.lit(1.0)).otherwise(both / whole)


def length_class(n: Column, threshold: float) -> Column:
    """The partition of sets of n spots: sets at `threshold` or above lie in the same
    one or in neighbouring ones."""
    return F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / -F.log(F.lit(threshold)) + 1e-9)


def alike(a: Column, b: Column, threshold: float = 0.8) -> Column:
    """Whether two sets reach a Jaccard similarity. Their partitions by length, then
    their lengths, rule most pairs out before any spot is compared."""
    n, m = F.size(a), F.size(b)
    far = F.abs(length_class(n, threshold) - length_class(m, threshold)) > 1
    short = F.least(n, m) < threshold * F.greatest(n, m) - 1e-9
    return F.when(far | short, F.lit(False)).otherwise(jaccard(a, b) >= threshold - 1e-12)


def similar(docs: DataFrame, threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members has (key, set_id) of each row; pairs has
    (a, b, jaccard) of all pairs of different non-empty sets at the threshold or above."""
    rows = saved(docs.select(F.col(key).alias(key), spots(F.col(text).cast("string")).alias("s")).withColumn("set_id", fingerprint(F.col("s"))), "spots")
    sets = saved(rows.groupBy("set_id").agg(F.first("s").alias("s")).where(F.size("s") > 0), "spots")
    each = sets.select("set_id", F.size("s").alias("n"), F.explode("s").alias("spot"))
    often = each.groupBy("spot").agg(F.count("*").alias("df"))
    order = Window.partitionBy("set_id").orderBy("df", "spot")
    prefix = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    # Partitions by length: a set meets its own length class and the next one only.
    band = length_class(F.col("n"), threshold)
    kept = each.join(often.where("df > 1"), "spot", "left").withColumn("df", F.coalesce("df", F.lit(1))).withColumn("at", F.row_number().over(order)).where(F.col("at") <= prefix).where("df > 1").select("set_id", "n", "spot", band.alias("band"))
    left, right = kept.alias("l"), kept.withColumn("band", F.explode(F.array("band", F.col("band") - 1))).alias("r")
    near = (F.col("l.spot") == F.col("r.spot")) & (F.col("l.band") == F.col("r.band"))
    ordered = (F.col("l.n") < F.col("r.n")) | ((F.col("l.n") == F.col("r.n")) & (F.col("l.set_id") < F.col("r.set_id")))
    cand = left.join(right, near & ordered & (F.col("l.n") >= threshold * F.col("r.n") - 1e-9)).select(F.col("l.set_id").alias("a"), F.col("r.set_id").alias("b")).distinct()
    pairs = cand.join(sets.select(F.col("set_id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("set_id").alias("b"), F.col("s").alias("sb")), "b")
    return rows.select(key, "set_id"), pairs.withColumn("jaccard", jaccard(F.col("sa"), F.col("sb"))).where(F.col("jaccard") >= threshold).select("a", "b", "jaccard")


def _ranged(rows: DataFrame, n: int) -> DataFrame:
    """rows (k, t) with their place (k, h, u) in the order and their range g.

    h, a hash of the text, orders rows of one key, and u, the row's place in the
    input, those of one key and text, so that a key with very many rows is many
    ranges. The bounds of the ranges are quantiles of a sample of places; the
    sample decides how even the ranges are, nothing else."""
    placed = rows.withColumn("at", F.struct("k", F.xxhash64("t").alias("h"), F.monotonically_increasing_id().alias("u")))
    ranges = min(MOST_RANGES, -(-n // NEIGHBOURS))
    drawn = placed.select("at").sample(min(1.0, 24 * ranges / n), seed=7).collect() if ranges > 1 else []
    drawn = sorted((tuple(r["at"]) for r in drawn), key=lambda x: (x[0] is not None, x[0] or 0, *x[1:]))
    bounds = [drawn[len(drawn) * i // ranges] for i in range(1, ranges)] if len(drawn) > ranges else []
    if not bounds:
        return placed.withColumn("g", F.lit(0))
    kind = "struct<k:bigint,h:bigint,u:bigint>"
    held = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(h).cast("long").alias("h"), F.lit(u).cast("long").alias("u")).cast(kind) for k, h, u in bounds])
    # How many bounds are not above the place, by halving steps.
    steps = [1 << i for i in range(len(bounds).bit_length() - 1, -1, -1)]
    found = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda i, s: F.when((i + s <= len(bounds)) & (F.get(held, i + s - 1) <= F.col("at")), i + s).otherwise(i))
    return placed.withColumn("g", found)


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, s, next_text, next_s): each row with the spots of its text and
    the row that follows by descending key (after the last: the first).

    Rows are dealt into ranges of the order; a range is sorted by one window.
    Only the last row of each range travels to the next one. There are at most
    MOST_RANGES ranges, so their last places may be broadcast.
    """
    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    n = rows.count()
    if not n:
        return rows.select(F.col("k").alias(key), F.col("t").alias(text), spots(F.col("t")).alias("s"), F.col("t").alias("next_text"), spots(F.col("t")).alias("next_s"))
    ranged = _ranged(rows, n)
    full = saved(ranged.groupBy("g").agg(F.max("at").alias("last")), "ranges")
    # The row before a range in ascending order is the last of the nearest range below, before the first that of the last range.
    order = Window.orderBy("g")
    top = full.agg(F.max("g")).first()[0]
    lend = full.select(F.coalesce(F.lead("g").over(order), F.min("g").over(Window.partitionBy())).alias("to_g"), F.col("g").alias("from_g"), "last")
    border = ranged.join(F.broadcast(lend), (ranged["g"] == lend["from_g"]) & (ranged["at"] == lend["last"]))
    one = border.groupBy("to_g").agg(F.max("t").alias("t")).select(F.lit(None).cast("long").alias("k"), "t", F.lit(None).cast(ranged.schema["at"].dataType).alias("at"), F.col("to_g").alias("g"), F.lit(0).alias("own"))
    every = ranged.select("k", "t", "at", "g", F.lit(1).alias("own")).unionByName(one)
    placed = (every.repartition("g") if top else every).select("k", "t", "at", "g", "own", spots(F.col("t")).alias("s"))
    w = Window.partitionBy("g").orderBy("own", "at")
    return placed.withColumn("next", F.lag(F.struct("t", "s")).over(w)).where("own = 1").select(F.col("k").alias(key), F.col("t").alias(text), "s", F.col("next.t").alias("next_text"), F.col("next.s").alias("next_s"))


def edited(text: Column, n: Column, other: Column) -> Column:
    """text with its last floor(n / 2) characters replaced by the first as many of other."""
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), (n - half).cast("int")), F.substring(other, F.lit(1), half))


def query(spark, sf_dir):
    from .common import table

    rows = with_next(table(spark, sf_dir, "documents"))
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("n_chars"), F.col("next_text")))
    rows = rows.withColumn("e", spots(F.col("edited")))
    return rows.select("doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), fingerprint(F.col("s")).alias("fingerprint"), fingerprint(F.col("e")).alias("edited_fingerprint"), jaccard(F.col("s"), F.col("e")).alias("near_edited"), jaccard(F.col("s"), F.col("next_s")).alias("near_next"), alike(F.col("s"), F.col("e")).alias("similar_edited"), alike(F.col("s"), F.col("next_s")).alias("similar_next"))
