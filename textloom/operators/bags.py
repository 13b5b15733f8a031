"""Pairs of two tables whose bags of tokens are alike, without moving the bags.

A text is read once, into the sorted hashes of its tokens with their counts (64 bits;
two of a million different tokens agree with a chance of 3 in 100 million). Equal bags are a class, and
only one row of each class goes on. Candidates come from the rarest uses of tokens
(prefix and positional filter), then a sketch of each bag rules most of them out, and
the bags of the rest are counted, each sent once to every group of pairs that needs it.
Nothing here is approximate but the order of tokens, which may be any.
"""

from __future__ import annotations

import ctypes
import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StructField, StructType

from ..storage import saved

#: Texts that the order of token uses is learned from, and the uses that it names. Both bound
#: work only: any order that all rows share gives the same pairs.
SAMPLE, NAMED = 10_000, 1_000_000
#: Rows up to which a table of ids is sent to every executor; larger ones are joined by a shuffle.
SENT = 500_000
#: Candidates are dealt by the blocks of their two ids, of so many texts at most and so many blocks at least.
BLOCK, LEAST_BLOCKS = 400_000, 8
#: Likely pairs of one group of texts from which it is dealt in tiles.
TILE = 20_000
#: Rows of one use that meet in one task; a use that the sample shows to have more is dealt in pairs of tiles.
USE_TILE = 20_000
#: Rows that are swept at once, and pairs that are held until they are handed on.
SWEPT, HELD = 200_000, 1_000_000
#: Parts of a tile's candidates, and candidates of a part that are sorted and told apart at once.
PARTS, PAIRS = 32, 2_000_000
#: Candidates from which on a part ends a call that judges them.
JUDGED = 50_000
#: Tokens of bags that are looked up at once.
LOOKED = 500_000
LEFT, RIGHT = 1, 2
#: Bytes of an Arrow batch.
BATCH_BYTES = 8 << 20


def _bounded(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow(run, schema) in batches of BATCH_BYTES (a smaller setting stays), whose workers
    give freed memory back when a task ends."""
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    now = conf.get(name, None) or "0"
    if now.lstrip("-").isdigit() and not 0 < int(now) <= BATCH_BYTES:  # with a unit: set by the user
        conf.set(name, str(BATCH_BYTES))

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return df.mapInArrow(trimmed, schema)


def _packed(h: np.ndarray, n: np.ndarray) -> bytes:
    """Hashes, then counts, as small as the largest count allows; the width comes first."""
    width = 1 if n.max(initial=0) < 1 << 8 else 4
    return bytes([width]) + h.tobytes() + n.astype(f"<u{width}").tobytes()


def _unpacked(bag: bytes) -> tuple[np.ndarray, np.ndarray]:
    k = (len(bag) - 1) // (8 + bag[0])
    return np.frombuffer(bag, "<u8", k, 1), np.frombuffer(bag, f"<u{bag[0]}", k, 1 + 8 * k).astype(np.int64)


def _sketch(h: np.ndarray, n: np.ndarray, size: int) -> bytes:
    """Counts modulo 256 of tokens dealt into a power of two of cells, an eighth of the size at least."""
    cells = 1 << min(12, max(3, math.ceil(math.log2(size / 8)))) if size > 8 else 8
    return np.bincount((h & np.uint64(cells - 1)).astype(np.int64), n, cells).astype(np.int64).astype(np.uint8).tobytes()


def _uses(h: np.ndarray, n: np.ndarray, group: int) -> np.ndarray:
    """49 bits for each use of a token in its group; the second use is an element of its own."""
    use = np.arange(n.sum(), dtype=np.uint64) - np.repeat(np.cumsum(n) - n, n).astype(np.uint64)
    x = np.repeat(h, n) ^ np.uint64(group * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = x + use * np.uint64(0xD1B54A32D192ED03)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(15)


def _read(width: int, tokens: int, distinct: int) -> Callable:
    """Rows (width columns, group, left, id, tokens) to the same without tokens, with size, class, sketch and bag."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, keep = batch.column(width + 3), []
            ends, hashes = found.offsets.to_numpy(), found.values.to_numpy(zero_copy_only=False).view(np.uint64)
            sizes, classes, sketches, bags = [], [], [], []
            for i, (group, left) in enumerate(zip(batch.column(width).to_pylist(), batch.column(width + 1).to_pylist())):
                size = int(ends[i + 1] - ends[i])
                if size < max(tokens, 1):
                    continue
                h, n = np.unique(hashes[ends[i] : ends[i + 1]], return_counts=True)
                if left and len(h) < distinct:
                    continue
                bag = _packed(h, n)
                keep.append(i)
                sizes.append(size)
                classes.append(hashlib.blake2b(group.to_bytes(8, "little", signed=True) + bag, digest_size=16).digest())
                sketches.append(size.to_bytes(4, "little") + _sketch(h, n, size))
                bags.append(bag)
            rest = [c.take(pa.array(keep, pa.int32())) for c in batch.columns[: width + 3]]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(sizes, pa.int32()), pa.array(classes, pa.binary()), pa.array(sketches, pa.binary()), pa.array(bags, pa.binary())], [*batch.schema.names[: width + 3], "size", "class", "sketch", "bag"])

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, bag) to (use, n): how many bags have a use."""
    held: list[np.ndarray] = []

    def out() -> pa.RecordBatch:
        e, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(e.astype(np.int64)), pa.array(n.astype(np.int64))], ["use", "n"])

    for batch in batches:
        for group, bag in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held.append(_uses(*_unpacked(bag), group))
            if len(held) >= 2_000 or len(held[-1]) > 1_000_000:
                yield out()
    if held:
        yield out()


def _dealt(kept: np.ndarray, at: np.ndarray, before: np.ndarray, i: int, scale: float) -> list[np.ndarray]:
    """The uses of one row, each once, or, if as many rows as its count in the sample tells
    have it, once for each pair of tiles that the row's tile makes: `at` tells the side in such a
    pair (1 or 2; 0: not dealt, or the tile with itself)."""
    tiles = np.maximum(1, np.ceil((kept >> 49) * (scale / USE_TILE))).astype(np.int64)
    if (tiles == 1).all():
        return [kept, at, before, np.full(len(kept), i)]
    row = np.repeat(np.arange(len(kept)), tiles)
    n, other = tiles[row], np.arange(tiles.sum()) - np.repeat(np.cumsum(tiles) - tiles, tiles)
    mine = (np.uint64(i) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)).astype(np.int64) % n
    low, high = np.minimum(mine, other), np.maximum(mine, other)
    mixed = (kept[row].astype(np.uint64) + (low * n + high).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)) * np.uint64(0xBF58476D1CE4E5B9)
    use = np.where(n == 1, kept[row], (mixed >> np.uint64(1)).astype(np.int64))
    side = np.where(low == high, 0, 1 + (mine == high))
    return [use, at[row] | (side << 30), before[row], np.full(len(row), i)]


def _prefixes(named, share: float, scale: float) -> Callable:
    """(id, group, flags, bag) to (use, at, before, id) of each row's rarest uses: `at` has
    the size, side, place and flags in one number that sorts by size, `before` the use ahead.
    scale: rows for each row of the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses, df = named.value
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            for i, group, flags, bag in zip(*(c.to_pylist() for c in batch.columns)):
                e = _uses(*_unpacked(bag), group)
                size, often = len(e), np.zeros(len(e), np.uint64)
                if len(uses):
                    j = np.minimum(np.searchsorted(uses, e), len(uses) - 1)
                    often = np.where(uses[j] == e, df[j], often)
                kept = np.sort((often << np.uint64(49)) | e)[: size - math.ceil(share * size - 1e-9) + 1].astype(np.int64)
                at = (size << 32) | (np.arange(1, len(kept) + 1) << 2) | flags
                for c, x in zip(out, _dealt(kept, at, np.concatenate([[0], kept[:-1]]), i, scale)):
                    c.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["use", "at", "before", "id"])

    return run


def _meetings(t: float, share: float) -> Callable:
    """Rows of _prefixes sorted by (use, at) to pairs (a, b) of ids that may reach Dice t.

    Rows of one use meet those after it up to the largest size that fits. If e is the first use that two
    rows share, they share 1 + what follows on the shorter side at most; rows that also
    share the use ahead of e have met there."""

    def swept(rows: list[np.ndarray], old: int) -> Iterator[pa.RecordBatch]:
        e, at, before, ids = rows
        size, side, place, flags = at >> 32, (at >> 30) & 3, (at >> 2) & (1 << 28) - 1, at & 3
        limit, found, n, i, k = size / share + 1e-6, [], 0, np.arange(len(e)), 0
        while len(i):
            k += 1
            i = i[i + k < len(e)]
            j = i + k
            near = (e[j] == e[i]) & (size[j] <= limit[i])
            i, j = i[near], j[near]
            fit = (j >= old) & (((flags[i] & LEFT) != 0) & ((flags[j] & RIGHT) != 0) | ((flags[i] & RIGHT) != 0) & ((flags[j] & LEFT) != 0))
            fit &= 1 + np.minimum(size[i] - place[i], size[j] - place[j]) >= t / 2 * (size[i] + size[j]) - 1e-6
            fit &= ((before[i] != before[j]) | (before[i] == 0)) & (ids[i] != ids[j]) & ((side[i] == 0) | (side[i] != side[j]))
            found.append((ids[i[fit]], ids[j[fit]]))
            n += len(found[-1][0])
            if n >= HELD or n and not len(i):
                x, y = (np.concatenate(c) for c in zip(*found))
                a, b = np.minimum(x, y), np.maximum(x, y)
                order = np.lexsort((a, b))
                a, b = a[order], b[order]
                new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
                yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], ["a", "b"])
                found, n = [], 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, kept = [], 0, [np.empty(0, np.int64)] * 4

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal held, n, kept
            rows = [np.concatenate([kept[c], *(x[c] for x in held)]) for c in range(4)]
            yield from swept(rows, len(kept[0]))
            last = np.searchsorted(rows[0], rows[0][-1])
            last += np.searchsorted(rows[1][last:] >> 32, math.ceil(share * (rows[1][-1] >> 32) - 1e-6))
            held, n, kept = [], 0, [c[last:].copy() for c in rows]

        for batch in batches:
            if batch.num_rows:
                held.append([c.to_numpy() for c in batch.columns])
                n += batch.num_rows
            if n >= SWEPT:
                yield from out()
        if n:
            yield from out()

    return run


class _Sketches:
    """Sketches of a tile by their width; pairs that the sketches do not rule out."""

    def __init__(self, ids: np.ndarray, values: list[bytes], t: float):
        order = np.argsort(ids)
        self.t, self.ids = t, ids[order]
        values = [values[i] for i in order]
        self.sizes = np.array([int.from_bytes(v[:4], "little") for v in values])
        widths = np.array([len(v) - 4 for v in values])
        self.width, self.row, self.cells = widths, np.zeros(len(ids), np.int64), {}
        for w in np.unique(widths):
            mine = np.flatnonzero(widths == w)
            self.row[mine] = np.arange(len(mine))
            self.cells[int(w)] = np.frombuffer(b"".join(values[i][4:] for i in mine), np.uint8).reshape(-1, w)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        i, j = np.searchsorted(self.ids, a), np.searchsorted(self.ids, b)
        far = np.zeros(len(a), np.int64)
        for wa, ca in self.cells.items():
            for wb, cb in self.cells.items():
                w = min(wa, wb)
                mine = np.flatnonzero((self.width[i] == wa) & (self.width[j] == wb))
                for part in np.array_split(mine, len(mine) * max(wa, wb) // 16_000_000 + 1) if len(mine) else ():
                    x, y = (c[self.row[k[part]]].reshape(len(part), -1, w).sum(1, dtype=np.uint8) for c, k in ((ca, i), (cb, j)))
                    d = x - y
                    far[part] = np.minimum(d, -d).sum(1, dtype=np.int64)  # around the circle of 256: never more than the true difference
        keep = far <= (1 - self.t) * (self.sizes[i] + self.sizes[j]) + 1e-6
        return [a[keep], b[keep]]


class _Bags:
    """Bags of a tile; pairs from `least` permille on with their permille.

    The tile's tokens are numbered once; a bag's counts are laid out by number, and all bags that meet it are looked up there."""

    names = ("a", "b", "permille")

    def __init__(self, ids: np.ndarray, values: list[bytes], least: int):
        order = np.argsort(ids)
        self.least, self.ids = least, ids[order]
        bags = [_unpacked(values[i]) for i in order]
        self.ends = np.cumsum([0, *(len(h) for h, _ in bags)])
        tokens, places = np.unique(np.concatenate([h for h, _ in bags]), return_inverse=True)
        self.places, self.counts = places.astype(np.int32), np.concatenate([n for _, n in bags]).astype(np.int32)
        self.sizes, self.laid = np.add.reduceat(self.counts, self.ends[:-1], dtype=np.int64), np.zeros(len(tokens), np.int32)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        out = np.zeros(len(a), np.int64)
        i, j = np.searchsorted(self.ids, a), np.searchsorted(self.ids, b)
        runs = [0, *(np.flatnonzero(j[1:] != j[:-1]) + 1).tolist(), len(j)]
        for lo, hi in zip(runs, runs[1:]):
            mine = slice(*self.ends[j[lo] : j[lo] + 2])
            self.laid[self.places[mine]] = self.counts[mine]
            # At most so many bags at once as have LOOKED entries.
            held = np.cumsum(self.ends[i[lo:hi] + 1] - self.ends[i[lo:hi]])
            cuts = [lo, *(lo + np.flatnonzero(np.diff(held // LOOKED)) + 1).tolist(), hi]
            for x, y in zip(cuts, cuts[1:]):
                starts, lengths = self.ends[i[x:y]], self.ends[i[x:y] + 1] - self.ends[i[x:y]]
                first = np.cumsum(lengths) - lengths
                at = np.arange(lengths.sum()) + np.repeat(starts - first, lengths)
                both = np.add.reduceat(np.minimum(self.counts[at], self.laid[self.places[at]]), first, dtype=np.int64)
                out[x:y] = 2000 * both // (self.sizes[i[x:y]] + self.sizes[j[lo]])
            self.laid[self.places[mine]] = 0
        keep = out >= self.least
        return [a[keep], b[keep], out[keep]]


class _Links(_Bags):
    """The same, but of each id of a tile the number of its pairs and the largest permille: a group
    of near copies makes as many rows as it has members, not as it has pairs."""

    names = ("id", "n", "permille")

    def __init__(self, ids: np.ndarray, values: list[bytes], least: int):
        super().__init__(ids, values, least)
        self.n, self.best = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        *ends, permille = super().__call__(a, b)
        for e in ends:
            at = np.searchsorted(self.ids, e)
            np.add.at(self.n, at, 1)
            np.maximum.at(self.best, at, permille)
        return [e[:0] for e in (*ends, permille)]

    def rest(self) -> list[np.ndarray]:
        some = self.n > 0
        return [c[some] for c in (self.ids, self.n, self.best)]


def _tiles(kind: type, least: float) -> Callable:
    """Rows (tile, a, b, value) sorted by (tile, b, a): the values of a tile's ids (b null), then its pairs, each judged once."""

    def ended(made) -> Iterator[pa.RecordBatch]:
        if isinstance(made, _Links):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in made.rest()], list(kind.names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, ids, values, made, last = None, [], [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            tiles, a, pair = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            b = batch.column(2).fill_null(0).to_numpy()
            cuts = [0, *(np.flatnonzero((tiles[1:] != tiles[:-1]) | (pair[1:] != pair[:-1])) + 1).tolist(), len(a)]
            for lo, hi in zip(cuts, cuts[1:]):
                if tiles[lo] != tile:
                    yield from ended(made)
                    tile, ids, values, made, last = tiles[lo], [], [], None, None
                if not pair[lo]:
                    ids.append(a[lo:hi])
                    values += batch.column(3).slice(lo, hi - lo).to_pylist()
                    continue
                if made is None:
                    made, values = kind(np.concatenate(ids), values, least), []
                x, y = a[lo:hi], b[lo:hi]
                new = np.concatenate([[last != (x[0], y[0])], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
                last = x[-1], y[-1]
                got = made(x[new], y[new])
                if len(got[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in got], list(kind.names))
        yield from ended(made)

    return run


def _sent(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= SENT else df


def _judged(pairs: DataFrame, values: DataFrame, kind: type, least: float) -> DataFrame:
    """pairs (tile, a, b) as `kind` judges them by the values (tile, id, value) of their tile."""
    none = F.lit(None)
    rows = values.select("tile", F.col("id").alias("a"), none.cast("long").alias("b"), "value").unionByName(pairs.select("tile", "a", "b", none.cast("binary").alias("value")))
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _bounded(rows.repartition(n, "tile").sortWithinPartitions("tile", "b", "a"), _tiles(kind, least), ", ".join(f"{c} long" for c in kind.names))


def _paired(run: Callable, blocks: int) -> Callable:
    """What `run` gives, pairs (a, b), as (tile, part, id, value): the pairs of a batch that are of one tile (the
    blocks of both ids) and part (of PARTS, by hash) are one value, and id is null."""

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in run(batches):
            a, b = got.column(0).to_numpy(), got.column(1).to_numpy()
            part = ((a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(32)).astype(np.int64) % PARTS
            place = (np.minimum(a % blocks, b % blocks) * blocks + np.maximum(a % blocks, b % blocks)) * PARTS + part
            order = np.argsort(place, kind="stable")
            a, b, place = a[order], b[order], place[order]
            cuts = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1, [len(a)]])
            values = [a[lo:hi].tobytes() + b[lo:hi].tobytes() for lo, hi in zip(cuts, cuts[1:])]
            place = place[cuts[:-1]]
            yield pa.RecordBatch.from_arrays([pa.array(place // PARTS), pa.array(place % PARTS), pa.nulls(len(place), pa.int64()), pa.array(values, pa.binary())], ["tile", "part", "id", "value"])

    return paired


def _likely(t: float) -> Callable:
    """Rows of _paired and (tile, -1, id, sketch), sorted by (tile, part), to the pairs that the sketches don't rule
    out. A pair that met several times is in one part, and is judged once for each PAIRS that the part has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sketches, made, held, n = (None, None), [], [], None, [], 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal made, sketches, held, n
            if not n:
                return
            if made is None:
                made, sketches = _Sketches(np.array(ids), sketches, t), []
            k = len(made.ids)
            met = np.unique(np.concatenate([np.searchsorted(made.ids, x[0]) * k + np.searchsorted(made.ids, x[1]) for x in held]))
            held, n = [], 0
            for lo in range(0, len(met), HELD):
                a, b = made(made.ids[met[lo : lo + HELD] // k], made.ids[met[lo : lo + HELD] % k])
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            for tile, part, i, value in zip(*(batch.column(c).to_pylist() for c in range(3)), batch.column(3)):
                if (tile, part) != now:
                    if tile != now[0] or n >= JUDGED:  # several small parts are judged in one call
                        yield from out()
                    if tile != now[0]:
                        ids, sketches, made = [], [], None
                    now = tile, part
                if part < 0:
                    ids.append(i)
                    sketches.append(value.as_py())
                    continue
                held.append(np.frombuffer(value.as_py(), np.int64).reshape(2, -1))
                n += held[-1].shape[1]
                if n >= PAIRS:
                    yield from out()
        yield from out()

    return run


def _sketched(starts: DataFrame, own: DataFrame, n: int, t: float) -> DataFrame:
    """The pairs of rows of _prefixes (sorted) that meet and that the sketches of `own` (n rows) don't rule out."""
    blocks = max(LEAST_BLOCKS, -(-n // BLOCK))
    schema = "tile long, part long, id long, value binary"
    met = _bounded(starts, _paired(_meetings(t, t / (2 - t)), blocks), schema)
    block, other = F.pmod("id", F.lit(blocks)), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    values = own.select("id", block.alias("block"), F.col("sketch").alias("value"), other.alias("other"))
    values = values.select((F.least("block", "other") * blocks + F.greatest("block", "other")).cast("long").alias("tile"), F.lit(-1).cast("long").alias("part"), "id", "value")
    tasks = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _bounded(met.unionByName(values).repartition(tasks, "tile").sortWithinPartitions("tile", "part"), _likely(t), "a long, b long")


def _verified(near: DataFrame, read: DataFrame, least: int, kind: type = _Bags) -> DataFrame:
    """near (a, b) with the permille of their bags, or what else `kind` makes of them.

    Texts that are alike have the same smallest neighbour more often than not, and pairs are dealt by those
    of their two texts, so that most bags go to one place; pairs of a large group go to several tiles."""
    ends = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    home = saved(ends.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("home")))
    both = near.join(home.withColumnRenamed("home", "ha"), "a").join(home.select(F.col("a").alias("b"), F.col("home").alias("hb")), "b")
    both = saved(both.select("a", "b", F.least("ha", "hb").alias("g"), F.greatest("ha", "hb").alias("h")))
    large = both.groupBy("g", "h").count().where(F.col("count") > TILE).select("g", "h", F.ceil(F.sqrt(F.col("count") / TILE)).alias("k"))
    k = F.coalesce("k", F.lit(1))
    part = lambda c: F.pmod(F.xxhash64(c), k)
    dealt = saved(both.join(F.broadcast(large), ["g", "h"], "left").select(F.xxhash64("g", "h", F.least(part("a"), part("b")), F.greatest(part("a"), part("b"))).alias("tile"), "a", "b"))
    needed = saved(dealt.select("tile", F.col("a").alias("id")).unionByName(dealt.select("tile", F.col("b").alias("id"))).distinct())
    bags = read.select("id", F.col("bag").alias("value")).join(_sent(needed, needed.count()), "id")
    return _judged(dealt, bags, kind, least)


def _pooled(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """rows with one text for each of the keys: the texts of repeated keys are one bag."""
    twice = rows.groupBy(*keys).count().where("count > 1").select(*keys)
    if twice.isEmpty():
        return rows
    twice = saved(twice)
    return rows.join(twice, keys, "left_anti").unionByName(rows.join(twice, keys, "left_semi").groupBy(*keys).agg(F.concat_ws("\n", F.collect_list(text)).alias(text)))


def _alike(rows: DataFrame, names: list[str], words: Callable[[Column], Column], least: int, tokens: int, distinct: int, alone: bool) -> tuple[DataFrame, DataFrame]:
    """rows (names, key, text, left) -> (members, found): members (names, key, left, id, rep, n, first,
    l, r) has the class of each row's bag, of which rep is a row and first the smallest key; found
    (a, b, permille) the pairs of classes. alone: all rows are on both sides, and found (id, n, permille)
    has the number of pairs of each class and the largest permille."""
    spark, t = rows.sparkSession, least / 1000
    share = t / (2 - t)
    hashed = F.transform(words(F.col("text")), lambda w: F.xxhash64(w))
    rows = rows.select(*names, "key", F.xxhash64(F.lit(0), *names).alias("group"), "left", F.monotonically_increasing_id().alias("id"), hashed.alias("tokens"))
    width = len(names) + 1
    schema = StructType([*rows.schema.fields[:width], StructField("group", LongType()), StructField("left", BooleanType()), StructField("id", LongType()), StructField("size", IntegerType()), *(StructField(c, BinaryType()) for c in ("class", "sketch", "bag"))])
    read = saved(_bounded(rows, _read(width, tokens, distinct), schema))

    sides = (F.lit(LEFT), F.lit(RIGHT)) if alone else (F.max(F.when(F.col("left"), LEFT).otherwise(0)), F.max(F.when(F.col("left"), 0).otherwise(RIGHT)))
    classes = read.groupBy("class").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.min("key").alias("first"), sides[0].alias("l"), sides[1].alias("r"))
    members = saved(read.select(*names, "key", "left", "id", "class").join(classes, "class").drop("class"))
    several = members.where("n > 1").select("id", (F.col("id") == F.col("rep")).alias("first"), (F.col("l") + F.col("r")).alias("both"))
    counts = members.agg(F.count("*").alias("n"), F.sum((F.col("n") > 1).cast("long")).alias("several")).first()
    own = read.join(_sent(several, counts["several"] or 0), "id", "left").where("coalesce(first, true)")

    part = min(1.0, SAMPLE / max(counts["n"], 1))
    drawn = own.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1_000_000)) < int(part * 1_000_000)).select("group", "bag")
    often = _bounded(drawn, _counted, "use long, n long").groupBy("use").agg(F.sum("n").alias("n")).where("n > 1")
    often = often.orderBy(F.col("n").desc(), "use").limit(NAMED).toArrow()
    uses, df = often.column("use").to_numpy().astype(np.uint64), often.column("n").to_numpy().astype(np.uint64)
    order = np.argsort(uses)
    named = spark.sparkContext.broadcast((uses[order], np.minimum(df[order], (1 << 14) - 1)))

    flags = F.lit(LEFT + RIGHT) if alone else F.coalesce("both", F.when(F.col("left"), LEFT).otherwise(RIGHT)).cast("int")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    starts = _bounded(own.select("id", "group", flags.alias("flags"), "bag"), _prefixes(named, share, 1 / part), "use long, at long, before long, id long")
    near = saved(_sketched(starts.repartition(n, "use").sortWithinPartitions("use", "at"), own, counts["n"], t))
    named.unpersist()
    return members, saved(_verified(near, read, least, _Links if alone else _Bags))


def like_classes(rows: DataFrame, on: tuple[str, ...], key: str, text: str, words: Callable[[Column], Column], least: int, tokens: int, distinct: int) -> DataFrame:
    """(on, key, class_id, n_links, permille): each row with its class, the smallest key
    whose text has the same bag of `words` (and `on`), and of the other classes whose Dice is `least`
    permille (over 0) or more the number and the largest permille.

    Texts of fewer than `tokens` tokens or `distinct` different ones are in no class and have no
    link; rows with a null have no row; the texts of repeated keys are one bag. Copies are a class, so the
    rows of the result are those of the input, however large a group of copies is."""
    names = [f"on{i}" for i in range(len(on))]
    given = _pooled(rows.select(*(F.col(c).alias(k) for c, k in zip(on, names)), F.col(key).alias("key"), F.col(text).alias("text")).dropna(), [*names, "key"], "text").withColumn("left", F.lit(True))
    members, found = _alike(given, names, words, least, tokens, distinct, True)
    links = found.groupBy(F.col("id").alias("rep")).agg(F.sum("n").alias("n_links"), F.max("permille").alias("permille"))
    classed = members.select(*names, "key", "rep", F.col("first").alias("class_id")).join(links, "rep", "left").drop("rep")
    out = given.select(*names, "key").join(classed, [*names, "key"], "left")
    return out.select(*(F.col(k).alias(c) for c, k in zip(on, names)), F.col("key").alias(key), "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("permille").cast("int").alias("permille"))


def like_pairs(left: DataFrame, right: DataFrame, on: tuple[str, ...], a: str, b: str, text: str, words: Callable[[Column], Column], least: int, tokens: int, distinct: int) -> DataFrame:
    """(on, a, b, permille): all pairs that agree in `on` and whose bags of `words` have a Dice of `least`
    permille (over 0), where both have `tokens` tokens and the left has `distinct` different ones."""
    names = [f"on{i}" for i in range(len(on))]
    side = lambda d, key, is_left: _pooled(d.select(*(F.col(c).alias(k) for c, k in zip(on, names)), F.col(key).alias("key"), F.col(text).alias("text")).dropna(), [*names, "key"], "text").withColumn("left", F.lit(is_left))
    # A union deals with keys of two types; the result has each side's own.
    members, found = _alike(side(left, a, True).unionByName(side(right, b, False)), names, words, least, tokens, distinct, False)
    x = members.where("left").select(*names, F.col("key").alias("x"), F.col("rep").alias("cx"))
    y = members.where("NOT left").select(*names, F.col("key").alias("y"), F.col("rep").alias("cy"))
    same = members.where("id = rep AND l > 0 AND r > 0").select(F.col("rep").alias("cx"), F.col("rep").alias("cy"), F.lit(1000).cast("long").alias("permille"))
    pairs = found.select(F.col("a").alias("cx"), F.col("b").alias("cy"), "permille").unionByName(found.select(F.col("b").alias("cx"), F.col("a").alias("cy"), "permille")).unionByName(same)
    pairs = pairs.where(F.col("permille") >= least).join(x, "cx").join(y, [*names, "cy"])
    own_type = lambda d, c, k: F.col(c).cast(d.schema[k].dataType).alias(k)
    return pairs.select(*(own_type(left, k, c) for c, k in zip(on, names)), own_type(left, "x", a), own_type(right, "y", b), F.col("permille").cast("int").alias("permille"))
