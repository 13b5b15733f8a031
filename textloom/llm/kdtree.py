"""Shards by a k-d tree over document metadata, in built-in functions only.

The root is all documents and stands for all shards. A node that stands for more
than one is cut along its widest dimension (its range, as a share of the root's)
at the weighted median: where the bytes on its left are to those on its right as
the shards of the two. Leaves are shards of nearly equal bytes. Nearby metadata
(source, language, length, id) so end in the same shard.

Medians are distributed: all nodes of a level are cut at once, by histograms of BINS
bins between a node's bounds, of which each task sends at most nodes * BINS sums.
The bin that holds the median is the next range, until it weighs next to nothing
(ERROR of a shard) or holds one unit. Behind a dimension stands a tie number, a hash
of the text, so any number of equal coordinates can be cut. The driver sees a row a
node and pass; rows are never sorted or moved by node, so a hot value costs nothing.

Equal texts are a group: they have the coordinates of their row with the smallest id
and one tie number, so they go to one shard. Groups of more than 1 / ATOMS of a shard
are dealt in parts of that size by their rows' ids; the parts are neighbours in
every order, and only so many can be cut apart. Groups of a shard's weight or less
may so lie in two shards, which equal sizes ask for. Repeated rows (equal in id,
text, source and language) are counted before anything moves, and numbered
in runs of many tasks.

Slots number a shard's rows from 0 without a gap: rows are dealt into buckets by
their hash, a bucket's start is the number of rows in those before it, and only
buckets of some SLOTS rows are ordered by one task each.

Defined cases: a null or empty text has no bytes, weighs 8, and is one group; a
null source or language is a value of its own, below all others, and so is a
null id; repeated rows get a slot each; a row heavier than a shard is a shard's
only one, or leaves its neighbours empty; with fewer rows than shards the other
shards are empty; other columns don't matter, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, saved

#: Bins of a histogram, and what of a shard's bytes the last bin may hold.
BINS, ERROR = 1 << 14, 0.0005
#: Bits of a dimension, and of a source's or language's number.
WIDE, NAMES = 18, 12
#: A group of more than 1 / ATOMS of a shard is dealt in parts.
ATOMS = 32
#: Tie numbers have TIE bits, of which the last PART name the part of a group.
TIE, PART = 44, 16
#: Rows of a bucket that is numbered by one task, and of a run of repeated rows.
SLOTS = 16_384
GROUP = ("h", "text_crc32", "size")


def _of_node(values: dict[int, int], shards: int) -> Column:
    """The value of a row's node: a literal array with a number a shard."""
    listed = ",".join(str(values[i]) if i in values else "" for i in range(shards))
    return F.try_element_at(F.split(F.lit(listed), ",").try_cast("array<bigint>"), (F.col("shard") + 1).cast("int"))


def kd_split(units: DataFrame, dims: list[str], shards: int, error: float = ERROR, bins: int = BINS) -> DataFrame:
    """units (bytes, tie and the dimensions, whole numbers below 2 ** TIE and 2 ** WIDE)
    with `shard`: the leaf of each, of `shards` leaves.

    Each cut lies between two units next to each other in the order of the widest
    dimension and tie, as near to the median as `error` of a shard's bytes lets it."""
    units = units.withColumn("shard", F.lit(0).cast("long"))
    nodes, root, done = {0: shards}, None, None
    key = lambda dim: F.element_at(F.array(*dims), (dim + 1).cast("int")) * (1 << TIE) + F.col("tie")
    while any(n > 1 for n in nodes.values()):
        found = units.groupBy("shard").agg(F.sum("bytes").alias("bytes"), *[f(d).alias(f"{name}_{d}") for d in dims for name, f in (("lo", F.min), ("hi", F.max))]).collect()
        root = root or {d: max(1, r[f"hi_{d}"] - r[f"lo_{d}"]) for r in found for d in dims}
        # Of each node the dimension, the range that holds the median, the bytes left of it, and the median's place in bytes.
        dim, lo, hi, before, want, slack = ({} for _ in range(6))
        for r in found:
            node, n = r["shard"], nodes[r["shard"]]
            if n == 1:
                continue
            i = max(range(len(dims)), key=lambda j: ((r[f"hi_{dims[j]}"] - r[f"lo_{dims[j]}"]) / root[dims[j]], -j))
            dim[node], before[node], want[node], slack[node] = i, 0, max(1, r["bytes"] * (n // 2) // n), error * r["bytes"] / n
            lo[node], hi[node] = r[f"lo_{dims[i]}"] << TIE, (r[f"hi_{dims[i]}"] + 1 << TIE) - 1
        at = key(_of_node(dim, shards))
        cut, left = {}, set(dim)
        while left:
            width = {x: (hi[x] - lo[x]) // bins + 1 for x in left}
            of = lambda values: _of_node({x: values[x] for x in left}, shards)
            inside = units.select("shard", "bytes", at.alias("key"), of(lo).alias("lo"), of(hi).alias("hi"), of(width).alias("width")).where(F.col("key").between(F.col("lo"), F.col("hi")))
            counts = inside.groupBy("shard", F.expr("(key - lo) div width").alias("bin")).agg(F.sum("bytes").alias("w"), F.count("*").alias("units"))
            need = of({x: want[x] - before[x] for x in left})
            counts = counts.withColumn("to", F.sum("w").over(Window.partitionBy("shard").orderBy("bin"))).where((F.col("to") >= need) & (F.col("to") - F.col("w") < need))
            for r in counts.collect():
                x = r["shard"]
                lo[x], before[x] = lo[x] + r["bin"] * width[x], before[x] + r["to"] - r["w"]
                hi[x] = min(hi[x], lo[x] + width[x] - 1)
                if width[x] == 1 or r["units"] == 1 or r["w"] <= slack[x]:
                    cut[x] = lo[x] if 2 * (want[x] - before[x]) <= r["w"] else hi[x] + 1
                    left.discard(x)
        if not cut:
            break
        right = at >= _of_node(cut, shards)
        units = units.withColumn("shard", F.when(right, _of_node({x: x + nodes[x] // 2 for x in cut}, shards)).otherwise(F.col("shard")))
        nodes = {a: n for x, k in nodes.items() for a, n in (((x, k // 2), (x + k // 2, k - k // 2)) if k > 1 else ((x, k),))}
        deeper = saved(units, "kd")  # else each level's conditions would be planned into all later ones
        dropped(done)
        units = done = deeper
    return units


def metadata(docs: DataFrame) -> DataFrame:
    """(doc_id, text_crc32, size, h, source, lang): a text's checksum, weight and hash,
    and the numbers of source and language, which as names have no order of their own."""
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = lambda c: F.coalesce(F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit((1 << NAMES) - 1)) + 1, F.lit(0)).cast("long").alias(c)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.crc32(body.cast("binary")).alias("text_crc32"), (F.octet_length(body) + 8).cast("long").alias("size"), F.xxhash64(body).alias("h"), name("source"), name("lang"))


DIMS = ["source", "lang", "length", "id"]


def shard_documents(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, error: float = ERROR) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of each row of docs, in `shards` shards,
    or as many as target_bytes asks for."""
    counted = saved(metadata(docs).groupBy("doc_id", *GROUP, "source", "lang").agg(F.count("*").alias("n")), "rows")
    least, most = (f("doc_id").cast("decimal(20, 0)") for f in (F.min, F.max))
    weight, rows, least, most = counted.agg(F.coalesce(F.sum(F.col("n") * F.col("size")), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(least, F.lit(0)), F.coalesce(most, F.lit(0))).first()
    shards = shards or max(1, -(-weight // (target_bytes or 1 << 30)))
    atom, many = max(1, weight // (shards * ATOMS)), max(SLOTS, rows // (shards * ATOMS))
    # Groups that are heavy or have many rows: less than ATOMS * shards of either kind.
    hot = counted.groupBy(*GROUP).agg(F.sum("n").alias("rows"), F.min(F.struct("doc_id", "source", "lang")).alias("first")).withColumn("heavy", F.col("rows") * F.col("size") > atom).where(F.col("heavy") | (F.col("rows") > many))
    parts = F.least(F.lit(1 << PART), F.greatest(F.ceil(F.col("rows") * F.col("size") / atom), F.ceil(F.col("rows") / many)))
    hot = saved(hot.select(*GROUP, "heavy", "first", parts.cast("long").alias("parts")), "hot")
    runs = F.greatest(F.ceil(F.col("n") * F.col("size") / atom), F.ceil(F.col("n") / SLOTS)).cast("long")
    runs = F.least(F.col("n"), runs)
    pieces = counted.join(F.broadcast(hot), list(GROUP), "left").withColumn("runs", runs).withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("runs") - 1)))
    pieces = pieces.withColumn("n", F.expr("n div runs + CASE WHEN run < n % runs THEN 1 ELSE 0 END"))
    pieces = pieces.withColumn("part", F.when(F.col("parts").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64("doc_id", "run"), F.col("parts"))))
    units = pieces.groupBy(*GROUP, "part").agg(F.sum(F.col("n") * F.col("size")).alias("bytes"), F.min(F.coalesce("first", F.struct("doc_id", "source", "lang"))).alias("first"), F.max("heavy").alias("heavy"))
    top = F.shiftrightunsigned("h", 64 - TIE)
    tie = F.when(F.col("heavy"), F.shiftleft(F.shiftrightunsigned("h", 64 - TIE + PART), PART) + F.col("part")).otherwise(top)
    # Lengths count by their order of magnitude, ids by where they lie between the least and the largest.
    step = (int(most) - int(least)) // ((1 << WIDE) - 1) + 1
    place = F.expr(f"(cast(first.doc_id AS decimal(20, 0)) - {int(least)}) div {step}").cast("long") + 1
    length = F.floor(F.log2("size") * 128)
    units = saved(units.select(*GROUP, "part", "bytes", tie.alias("tie"), "first.source", "first.lang", length.alias("length"), F.coalesce(place, F.lit(0)).cast("long").alias("id")), "units")
    leaf = kd_split(units, DIMS, shards, error).select(*GROUP, "part", F.col("shard").cast("int").alias("shard"))
    buckets = max(1, rows // (shards * SLOTS))
    bucket = F.pmod(F.xxhash64("doc_id", "h", "run"), F.lit(buckets)).alias("bucket")
    placed = saved(pieces.join(leaf, [*GROUP, "part"]).select("doc_id", "size", "text_crc32", "h", "run", "n", "source", "lang", "shard", bucket), "placed")
    return numbered(placed, ["doc_id", "text_crc32", "size", "h", "source", "lang", "run"]).select("doc_id", "size", "text_crc32", "shard", "slot")


def numbered(placed: DataFrame, order: list[str]) -> DataFrame:
    """Each row of placed (shard, bucket, n) n times, with its slot in its shard."""
    starts = placed.groupBy("shard", "bucket").agg(F.sum("n").alias("rows"))
    starts = starts.withColumn("start", F.sum("rows").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("rows")).drop("rows")
    ends = F.sum("n").over(Window.partitionBy("shard", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first = placed.withColumn("first", ends - F.col("n")).join(starts, ["shard", "bucket"]).withColumn("first", F.col("first") + F.col("start"))
    return first.withColumn("slot", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)))


def query(spark, sf_dir):
    from .common import table

    rows = shard_documents(table(spark, sf_dir, "documents"), shards=24)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
