"""SimHash near-duplicate detection.

Fingerprint: every k-word shingle of a text, repeats included, is hashed with
XXH64; a bit of the fingerprint is set if it is set in over half the hashes.

Links: fingerprints at `radius` or fewer differing bits. The 64 bits are split
into radius + 2 blocks; a close pair differs in at most `radius` of them, so it
agrees in at least two. Each distinct fingerprint is keyed by each pair of its
blocks (15 keys of about 21 bits at radius 4), keys are joined by one
shuffle, and within a key all pairs are verified by Hamming distance in arrays.
Only links that join two fingerprints not yet joined within the key are given
out (a spanning forest), so the output is linear in a key's members though no
pair goes unverified. A key with over TILE members is dealt as pairs of tiles to
many tasks. Documents with equal fingerprints are one member from the start.

Components of the links come from distributed star contraction.

near_copies() is the deduplication of a pipeline: five-word shingles and a
similarity (Jaccard) of 0.8 or more. Texts that similar differ in 11 of 64 bits
in the median (measured on the test tables), beyond what blocks can find, so
the 64-bit blocks are joined by sampled blocks: SAMPLES blocks of BLOCK_SYMBOLS
minwise-sampled shingle symbols, of which a pair at 0.8 shares at least one with
a probability of 0.99999. Within a block every member links to the smallest. The
share of SYMBOLS sampled symbols that agree estimates a link's similarity with a
standard error of 0.025 at 0.8: below DOUBT (four standard errors) a link is none,
from there on the Jaccard of the two whole shingle sets decides. In blocks that this leaves in several
parts, the members outside the smallest's part meet all other members in tiles:
of the pairs at DOUBT or more the Jaccard of the whole shingle sets decides, from
the best estimate down, unless verified pairs have joined their parts already.

Defined cases: null and empty texts and texts without a word have fingerprint
zero, which links like any other; fewer than k words make one shingle; repeated
rows are given back each; a null doc_id keeps its fingerprint and has the
smallest non-null doc_id of its component (null if there is none); an empty
table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, saved, trimmed
from .components import connected_components

TILE = 8192
#: Shingles whose bits are counted at a time.
STEP = 100_000
SAMPLES, BLOCK_SYMBOLS, SYMBOLS = 16, 3, 256
#: Jaccard of near copies, and the estimate from which on it is computed.
LEAST, DOUBT = 0.8, 0.7
#: Members of a tile of a block that its smallest left in several parts.
REST_TILE = 1024


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 (seed 42) of each k-word shingle of a text, as uint64."""
    import xxhash

    # bytes.lower() and bytes.split() know A-Z and the six ASCII white-space characters only.
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line, n = b" ".join(words), max(1, len(words) - k + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.r_[0, ends[:-1]][:n].tolist()
    stops = (ends[min(k, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], 42) for a, b in zip(starts, stops)), np.uint64, n)


def simhash(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    set_in = np.zeros(64, np.int64)
    for at in range(0, len(hashes), STEP):
        set_in += np.unpackbits(hashes[at : at + STEP].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_in * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, k: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): the fingerprint of each whole text as a signed long."""
    frame = bounded_batches(docs).select(docs[key].cast("long").alias(key), docs[text].cast("string").alias(text))

    def run(batches):
        for b in batches:
            fps = np.array([simhash(shingle_hashes(t.as_py(), k)) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=[key, "fp"])

    return frame.mapInArrow(run, f"`{key}` long, fp long")


def blocks(radius: int) -> list[tuple[int, int]]:
    """(first bit, bits) of radius + 2 blocks that together are the 64 bits."""
    n = radius + 2
    edge = [round(64 * i / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edge, edge[1:])]


def block_keys(fp, radius: int):
    """An array column: a key for each pair of blocks of a fingerprint."""
    part = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << n) - 1)) for a, n in blocks(radius)]
    pairs = list(combinations(range(radius + 2), 2))
    return F.array(*[F.shiftleft(F.shiftleft(part[i], 24).bitwiseOR(part[j]), 12).bitwiseOR(F.lit(c)) for c, (i, j) in enumerate(pairs)])


def _forest(keys: np.ndarray, side: np.ndarray, fp: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Links of a spanning forest of the pairs within each run of equal keys.

    side: 0 pairs with all of its run, 1 only with 2 and 2 with 1 (tiles)."""
    n = len(keys)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    end = np.repeat(np.r_[first[1:], n], np.diff(np.r_[first, n]))
    root = list(range(n))

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    a, b, label, looped, d = [], [], np.arange(n), 0, 0
    live = np.arange(n)
    while len(live):
        d += 1
        live = live[live + d < end[live]]
        x, y = live, live + d
        ok = (label[x] != label[y]) & ((side[x] == 0) | (side[x] != side[y]))
        x, y = x[ok], y[ok]
        close = np.bitwise_count(fp[x] ^ fp[y]) <= radius
        x, y = x[close].tolist(), y[close].tolist()
        looped += len(x)
        for i, j in zip(x, y):
            p, q = top(i), top(j)
            if p != q:
                root[max(p, q)] = min(p, q)
                a.append(i)
                b.append(j)
        alive = np.unique(np.r_[live, live + d])
        if looped > len(alive):  # members already joined need no more verifying
            label[alive], looped = list(map(top, alive.tolist())), 0
    return a, b


def _whole_runs(batches):
    """The columns of sorted batches as arrays, cut where (key, tile) changes."""
    kept = None
    for b in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if kept is not None:
            cols = [np.concatenate(x) for x in zip(kept, cols)]
        key, tile = cols[0], cols[1]
        if not len(key):
            continue
        cut = np.flatnonzero((key == key[-1]) & (tile == tile[-1]))[0]  # the last run may go on
        kept = [c[cut:] for c in cols]
        if cut:
            yield [c[:cut] for c in cols]
    if kept is not None and len(kept[0]):
        yield kept


def _run_numbers(key: np.ndarray, tile: np.ndarray) -> np.ndarray:
    return np.cumsum(np.r_[0, (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])])


def _verified(radius: int):
    def run(batches):
        yield from map(links, _whole_runs(batches))

    def links(cols):
        key, tile, side, fp = cols
        a, b = _forest(_run_numbers(key, tile), side, fp.view(np.uint64), radius)
        return pa.RecordBatch.from_arrays([pa.array(fp[a] if a else np.empty(0, np.int64)), pa.array(fp[b] if b else np.empty(0, np.int64))], names=["a", "b"])

    return run


def _dealt(keyed: DataFrame, member: str, most: int) -> DataFrame:
    """(key, tile, side, member) of keys with two members or more, by (key, tile):
    a key with over `most` members becomes tiles, dealt as pairs of tiles."""
    size = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    tiles = F.ceil(F.col("n") / most).cast("int")
    own = F.pmod(F.xxhash64(member), F.col("tiles")).cast("int")
    met = keyed.join(size, "key").withColumn("tiles", tiles).withColumn("own", own)
    # Tile pair (i, j), i <= j, as i * tiles + j: a member of tile t meets all others once.
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    met = met.select("key", member, "tiles", "own", other)
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return met.select("key", (low * F.col("tiles") + high).cast("long").alias("tile"), side.cast("int").alias("side"), member).repartition("key", "tile")


def close_pairs(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b) links between distinct fingerprints (column fp): a forest within
    each key, whose components are those of all pairs at `radius` bits or fewer."""
    keyed = distinct.select(F.explode(block_keys(F.col("fp"), radius)).alias("key"), "fp")
    met = _dealt(keyed, "fp", TILE).sortWithinPartitions("key", "tile", "side", "fp")
    return met.mapInArrow(_verified(radius), "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 4, radius: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component_id) of each row; component_id is the smallest key
    that links reach, the row's own included."""
    made = saved(fingerprints(docs, k, key, text), "fp")
    distinct = saved(made.groupBy("fp").agg(F.min(key).alias("low")), "fp")
    parts = connected_components(close_pairs(distinct, radius))
    low = distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = low.groupBy("component").agg(F.min("low").alias("component_id"))
    low = low.join(named, "component").select("fp", "component_id")
    return made.join(low, "fp").select(key, "fp", "component_id")


def _multipliers() -> np.ndarray:
    """SYMBOLS odd 64-bit numbers, from the golden ratio's multiples."""
    with np.errstate(over="ignore"):
        x = np.arange(1, SYMBOLS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x | np.uint64(1)


def symbols(hashes: np.ndarray) -> np.ndarray:
    """SYMBOLS minwise samples of a set of shingle hashes (none: zeros)."""
    out = np.zeros(SYMBOLS, np.uint64)
    if len(hashes):
        hashes = np.unique(hashes)
        out[:] = np.iinfo(np.uint64).max
        for at in range(0, len(hashes), 4096):
            out = np.minimum(out, (hashes[at : at + 4096, None] * _MULTIPLIERS).min(0))
    return out


_MULTIPLIERS = _multipliers()


def _sketches(k: int):
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                fps, keys, marks = [], [], []
                for t in part.column(1):
                    h = shingle_hashes(t.as_py(), k)
                    s = symbols(h)
                    fps.append(simhash(h))
                    # A block's key mixes its symbols and its place.
                    block = s[: SAMPLES * BLOCK_SYMBOLS].reshape(SAMPLES, BLOCK_SYMBOLS)
                    key = np.arange(SAMPLES, dtype=np.uint64)
                    for c in range(BLOCK_SYMBOLS):
                        key = (key ^ block[:, c]) * _MULTIPLIERS[c]
                        key ^= key >> np.uint64(29)
                    keys.append(key.view(np.int64))
                    marks.append((s >> np.uint64(24)).astype("<u2").tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.binary())], names=["node", "fp", "keys", "marks"])
        trimmed()

    return run


def _marked(marks) -> np.ndarray:
    return np.frombuffer(b"".join(marks), "<u2").reshape(-1, SYMBOLS)


def agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    """The share of symbols that two sketches have in common."""
    return pd.Series((_marked(a) == _marked(b)).mean(axis=1) if len(a) else [], dtype=float)


def _likely(marks: np.ndarray, side: np.ndarray, label: np.ndarray, floor: float) -> list[tuple]:
    """(shares, i, j), as arrays, of the pairs of sketches with two labels that
    agree in `floor` or more. side: as for _forest."""
    found = []
    for i in range(len(marks) - 1):
        j = i + 1 + np.flatnonzero((label[i + 1 :] != label[i]) & ((side[i] == 0) | (side[i + 1 :] != side[i])))
        share = (marks[j] == marks[i]).mean(1)
        near = share >= floor
        found.append((share[near], np.full(near.sum(), i), j[near]))
    return found


def true_forest(marks: np.ndarray, side: np.ndarray, label: np.ndarray, sets: list[bytes], floor: float, least: float) -> list[tuple[int, int]]:
    """(i, j): a spanning forest of the labels over all pairs of _likely whose
    sets are `least` or more alike. Only a pair that is verified joins, so no
    pair is passed over for a false one."""
    found = _likely(marks, side, label, floor)
    if not found:
        return []
    share, a, b = (np.concatenate(x) for x in zip(*found))
    root, kept = list(range(len(marks))), []
    for c in np.lexsort((b, a, -share)).tolist():
        i, j = int(a[c]), int(b[c])
        p, q = int(label[i]), int(label[j])
        while root[p] != p:
            root[p] = root[root[p]]
            p = root[p]
        while root[q] != q:
            root[q] = root[root[q]]
            q = root[q]
        if p != q and alike(sets[i], sets[j], least):
            root[max(p, q)] = min(p, q)
            kept.append((i, j))
    return kept


def _tiles(cols) -> list[tuple[int, int]]:
    """(first, end) of each (key, tile) of whole runs."""
    runs = _run_numbers(cols[0], cols[1])
    edges = np.flatnonzero(np.r_[True, runs[1:] != runs[:-1], True]).tolist()
    return list(zip(edges[:-1], edges[1:]))


def _numbered(label: np.ndarray) -> np.ndarray:
    return np.unique(label, return_inverse=True)[1]


def _in_question(floor: float):
    """The members of tiles that have a pair in _likely."""

    def run(batches):
        for cols in _whole_runs(batches):
            key, tile, side, node, label, marks = cols
            asked = np.zeros(len(key), bool)
            for x, y in _tiles(cols):
                for _, i, j in _likely(_marked(marks[x:y]), side[x:y], _numbered(label[x:y]), floor):
                    asked[x + i] = asked[x + j] = True
            yield pa.RecordBatch.from_arrays([pa.array(key[asked]), pa.array(tile[asked]), pa.array(side[asked]), pa.array(node[asked], pa.string()), pa.array(label[asked], pa.string())], names=["key", "tile", "side", "node", "label"])

    return run


def _joined(floor: float, least: float):
    def run(batches):
        for cols in _whole_runs(batches):
            _, _, side, label, marks, sets = cols
            a, b = [], []
            for x, y in _tiles(cols):
                for i, j in true_forest(_marked(marks[x:y]), side[x:y], _numbered(label[x:y]), sets[x:y], floor, least):
                    a.append(label[x + i])
                    b.append(label[x + j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], names=["a", "b"])
        trimmed()

    return run


def _shingle_sets(k: int):
    def run(batches):
        for b in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), k)).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["node", "set"])

    return run


def jaccard(a: bytes, b: bytes) -> float:
    """Of two sorted sets of 64-bit hashes; two empty sets are equal."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def alike(a: bytes, b: bytes, least: float) -> bool:
    """Whether jaccard(a, b) is `least` or more, which very unequal sizes rule out."""
    return min(len(a), len(b)) >= least * max(len(a), len(b)) and jaccard(a, b) >= least


def _alike(least: float):
    def run(batches):
        for b in batches:
            ok = [jaccard(x.as_buffer(), y.as_buffer()) >= least for x, y in zip(b.column(2), b.column(3))]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _both(links: DataFrame, side: DataFrame, value: str) -> DataFrame:
    """links with the value of side (node, value) of both ends, as x and y."""
    for end, name in (("a", "x"), ("b", "y")):
        links = links.join(side.select(F.col("node").alias(end), F.col(value).alias(name)), end)
    return links


def _sets(nodes: DataFrame, texts: DataFrame, first: DataFrame, k: int) -> DataFrame:
    """(node, set) of the nodes. first (node, i) names one row of each text, so that
    its copies are told apart, and dealt, by their ids before they are dropped."""
    wanted = saved(first.join(nodes.distinct(), "node"), "wanted")
    sets = texts.join(wanted, ["node", "i"], "left_semi").select("node", "t").mapInArrow(_shingle_sets(k), "node string, set binary")
    return saved(sets.groupBy("node").agg(F.first("set").alias("set")), "sets")


def _decided(links: DataFrame, texts: DataFrame, first: DataFrame, k: int, least: float) -> DataFrame:
    """(a, b) of the links (a, b) whose texts are `least` or more alike."""
    sets = _sets(links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))), texts, first, k)
    return saved(_both(links, sets, "set").select("a", "b", "x", "y").mapInArrow(_alike(least), "a string, b string"), "alike")


def _opened(stars: DataFrame, parts: DataFrame) -> DataFrame:
    """(key, tile, side, node, label) of the blocks whose members the links with
    their smallest (stars: key, a, b) left in several parts; label: the part.

    Members outside the smallest's part meet each other and those inside; those
    inside don't meet. The smallest has met all. Over REST_TILE members become
    tiles: first of those outside, then of those inside."""
    named = stars
    for end, name in (("a", "label"), ("b", "home")):
        named = named.join(parts.select(F.col("node").alias(end), F.col("component").alias(name)), end, "left").withColumn(name, F.coalesce(name, end))
    named = saved(named.select("key", F.col("a").alias("node"), "label", (F.col("label") != F.col("home")).alias("outside")), "named")
    n_out, n_in = F.count_if("outside"), F.count_if(~F.col("outside"))
    size = named.groupBy("key").agg(n_out.alias("n_out"), n_in.alias("n_in")).where("n_out > 0 AND n_out + n_in > 1")
    whole = F.col("n_out") + F.col("n_in") <= REST_TILE
    tiles = lambda n: F.ceil(F.col(n) / REST_TILE).cast("int")
    met = named.join(size, "key").withColumn("t_out", F.when(whole, 1).otherwise(tiles("n_out"))).withColumn("t_in", F.when(whole, 0).otherwise(tiles("n_in")))
    at = F.xxhash64("node")
    own = F.when(whole, 0).when(F.col("outside"), F.pmod(at, F.col("t_out"))).otherwise(F.col("t_out") + F.pmod(at, F.greatest("t_in", F.lit(1))))
    most = F.col("t_out") + F.when(F.col("outside"), F.col("t_in")).otherwise(0)
    met = met.withColumn("own", own.cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), most - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return met.select("key", (low * (F.col("t_out") + F.col("t_in")) + high).cast("long").alias("tile"), side.cast("int").alias("side"), "node", "label")


def near_copies(docs: DataFrame, k: int = 5, radius: int = 4, least: float = LEAST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, one of each group of near copies: the one with the
    smallest key (of repeated rows one; a null key only if there is no other)."""
    node = F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))
    ids = saved(docs.select(F.col(key).cast("long").alias("id"), node.alias("node")).groupBy("node", "id").agg(F.count("*").alias("n")), "copies")
    named = F.coalesce(F.col(key).cast("long").cast("string"), F.lit(""))
    texts = bounded_batches(docs).select(node.alias("node"), F.col(text).cast("string").alias("t"), named.alias("i"))
    one = ids.groupBy("node").agg(F.min(F.coalesce(F.col("id").cast("string"), F.lit(""))).alias("i"))
    # Sketches of whole texts before the shuffle: a text's copies have equal sketches, one stays.
    made = texts.select("node", "t").mapInArrow(_sketches(k), "node string, fp long, keys array<long>, marks binary")
    made = saved(made.groupBy("node").agg(F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.first("marks").alias("marks")), "sketches")
    low = saved(made.groupBy("fp").agg(F.min("node").alias("low")), "fp")
    same = made.select("node", "fp").join(low, "fp").select(F.col("node").alias("a"), F.col("low").alias("b"))
    close = close_pairs(low.select("fp"), radius).join(low.select(F.col("fp").alias("a"), F.col("low").alias("la")), "a").join(low.select(F.col("fp").alias("b"), F.col("low").alias("lb")), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    keyed = made.select(F.explode("keys").alias("key"), "node")
    first = keyed.groupBy("key").agg(F.min("node").alias("low"), F.count("*").alias("n")).where("n > 1")
    stars = saved(keyed.join(first, "key").where("node <> low").select("key", F.col("node").alias("a"), F.col("low").alias("b")), "stars")
    links = same.unionByName(close).unionByName(stars.select("a", "b")).where("a <> b").distinct()
    marks = made.select("node", "marks")
    agree = F.pandas_udf(agreement, "double")
    shares = _both(links, marks, "marks").select("a", "b", agree("x", "y").alias("share")).where(F.col("share") >= DOUBT)
    alike = _decided(saved(shares.select("a", "b"), "shares"), texts, one, k, least)
    parts = saved(connected_components(alike), "parts")
    met = _opened(stars, parts).join(marks, "node").select("key", "tile", "side", "node", "label", "marks")
    met = met.repartition("key", "tile").sortWithinPartitions("key", "tile", "side", "node").mapInArrow(_in_question(DOUBT), "key long, tile long, side int, node string, label string")
    asked = saved(met, "asked")
    met = bounded_batches(asked).join(marks, "node").join(_sets(asked.select("node"), texts, one, k), "node").select("key", "tile", "side", "label", "marks", "set")
    met = met.repartition("key", "tile").sortWithinPartitions("key", "tile", "side", "label").mapInArrow(_joined(DOUBT, least), "a string, b string")
    parts = connected_components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(met))
    members = ids.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    winner = members.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("node").alias("node"))).alias("w"))
    name = lambda n, i: F.concat_ws(":", n, F.coalesce(i.cast("string"), F.lit("")))
    chosen = winner.select(name(F.col("w.node"), F.col("w.id")).alias("winner"))
    rows = docs.select(F.struct("*").alias("row"), name(node, F.col(key).cast("long")).alias("winner")).join(chosen, "winner")
    once = F.row_number().over(Window.partitionBy("winner").orderBy("winner"))
    return rows.withColumn("once", once).where("once = 1").select("row.*")


def query(spark, sf_dir):
    from .common import table

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


__all__ = ["close_pairs", "fingerprints", "near_copies", "near_duplicates", "query", "shingle_hashes", "simhash"]
