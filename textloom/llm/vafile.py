"""Product codes of vectors, whose nearest entries a VA-file filters.

A vector of whole numbers is cut into equal consecutive parts; each part has a
codebook of a few entries, and a vector's code names the nearest entry of each
part. Codebooks are fitted by rounds of assignment and replacement.

Nearest entries are found as in a VA-file (Weber, Schek and Blott, 1998): the
entries' coordinates are quantised to BITS bits, that is to cells of each
dimension. A query part gets a lookup table for each dimension with the least and
the largest squared difference to each cell; summed over an entry's cells they
bound its distance from below and from above. Entries whose lower bound lies above
the smallest upper bound are out, and only where more than one is left the exact
integer distances of those are taken.

Each round is one pass over the vectors: tasks return sums and counts of their
entries, which Spark adds up (exact 64-bit sums), and what reaches the driver is
the next codebook, of parts * entries rows whatever the input. Vectors are never
grouped and never leave their partition, so no key can be hot. The labels' sums
are added before any shuffle; where there are too many labels to broadcast, rows
meet them under SALTS keys a label.

Defined cases: vectors that are null, or hold null or non-finite components, or
components beyond 2 ** 25 in whole numbers (which 64 bits could not sum exactly),
take no part, nor do those of another length than the one with the smallest id,
or of a length that the parts don't divide; with fewer vectors than entries the
codebook has as many entries as vectors; of repeated ids the vector that sorts
first comes first, and all rows get their code; rows without an id come last;
null labels are a label; other columns don't matter, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, trimmed

BITS = 3
#: Vectors that are compared at a time, and the largest component.
STEP, MOST = 8192, 1 << 25
#: Labels up to this number are broadcast (some 16 bytes each), others met under salted keys.
LABELS, SALTS = 1_000_000, 64


class VAFile:
    """The entries of one part's codebook (a row each) and their cells."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries, cells = entries.astype(np.int64), 1 << bits
        low, high = self.entries.min(axis=0), self.entries.max(axis=0)
        width = (high - low) // cells + 1
        self.cell = (self.entries - low) // width
        #: Least and largest whole number of each cell, by dimension.
        self.least = low[:, None] + width[:, None] * np.arange(cells)
        self.largest = self.least + width[:, None] - 1

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of squared distances, a row a query and a column an entry."""
        lower = np.zeros((len(queries), len(self.entries)), np.int64)
        upper = np.zeros_like(lower)
        for d in range(queries.shape[1]):
            below, above = self.least[d] - queries[:, d, None], queries[:, d, None] - self.largest[d]
            near, far = np.maximum(np.maximum(below, above), 0), np.maximum(-below, -above)
            lower += (near * near)[:, self.cell[:, d]]
            # Outside of a cell one of the two is negative, and the other end is the farther one.
            upper += (far * far)[:, self.cell[:, d]]
        return lower, upper

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(entry, squared distance) of each query, ties to the first entry, and how
        many distances were refined."""
        lower, upper = self.bounds(queries)
        rows, which = np.nonzero(lower <= upper.min(axis=1)[:, None])
        off = queries[rows] - self.entries[which]
        exact = np.full(lower.shape, np.iinfo(np.int64).max)
        exact[rows, which] = (off * off).sum(axis=1)
        best = exact.argmin(axis=1)
        return best, exact[np.arange(len(best)), best], len(rows)


def whole_numbers(vectors: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """(id, v): floor(scale * x) of each component, of the vectors that take part."""
    v = F.col("v")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x * scale) > float(MOST))
    taken = vectors.select(vectors[key].cast("long").alias("id"), vectors[vector].cast("array<double>").alias("v")).where(v.isNotNull() & ~F.exists("v", bad))
    return taken.select("id", F.transform("v", lambda x: F.floor(x * scale)).alias("v"))


def _matrix(column: pa.Array, dim: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers of the vectors of a batch that take part, and their places."""
    flat, ends = column.flatten(), np.asarray(column.value_lengths().fill_null(-1))
    values = np.asarray(flat.cast(pa.float64()).fill_null(np.nan), np.float64)
    fits, starts = ends == dim, np.concatenate([[0], np.cumsum(np.maximum(ends, 0))[:-1]]).astype(np.int64)
    at = np.flatnonzero(fits)
    x = values[starts[at, None] + np.arange(dim)] * scale
    with np.errstate(invalid="ignore"):
        good = (np.abs(x) <= MOST).all(axis=1) if dim else np.zeros(len(at), bool)
    return np.floor(x[good]).astype(np.int64), at[good]


def _assign(files: list[VAFile], x: np.ndarray) -> Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Steps of (parts of vectors, entry of each part, squared distance of each part)."""
    for at in range(0, len(x), STEP):
        cut = x[at : at + STEP].reshape(-1, len(files), x.shape[1] // len(files))
        found = [f.nearest(cut[:, p]) for p, f in enumerate(files)]
        yield cut, np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _sums(vectors: DataFrame, books: np.ndarray, scale: float, bits: int) -> DataFrame:
    """(part, entry, place, total, n) over all vectors: sums and counts of the parts of each entry."""
    parts, _, size = books.shape
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("place", pa.int32()), ("total", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]):
        files, total, n = [VAFile(b, bits) for b in books], np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for b in batches:
            x, _ = _matrix(b.column(0), parts * size, scale)
            for cut, entry, _ in _assign(files, x):
                for p in range(parts):
                    own = entry[:, p, None] == np.arange(books.shape[1])
                    total[p] += (own.T.astype(np.float64) @ cut[:, p]).astype(np.int64)  # below STEP * MOST: exact in doubles
                    n[p] += own.sum(axis=0)
        p, e, i = (a.ravel() for a in np.indices(books.shape))
        used = n[p, e] > 0
        yield pa.RecordBatch.from_arrays([pa.array(c[used]) for c in (p.astype(np.int32), e.astype(np.int32), i.astype(np.int32), total.ravel(), n[p, e])], schema=schema)

    partial = vectors.select("v").mapInArrow(run, "part int, entry int, place int, total long, n long")
    return partial.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def fit(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6, scale: float = 4096.0, bits: int = BITS) -> np.ndarray | None:
    """Codebooks (part, entry, place) of whole numbers; None if no vector takes part.

    They start as the parts of the vectors with the smallest ids; each round
    replaces an entry by the floored mean of its parts, and keeps it if it has none."""
    start = whole_numbers(vectors, key, vector, scale)
    first = start.orderBy(F.col("id").asc_nulls_last(), "v").limit(1).collect()
    if not first or not len(first[0]["v"]) or len(first[0]["v"]) % parts:
        return None
    dim = len(first[0]["v"])
    rows = start.where(F.size("v") == dim).orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    books = np.array([r["v"] for r in rows], np.int64).reshape(-1, parts, dim // parts).transpose(1, 0, 2).copy()
    source = vectors.select(vectors[vector].alias("v"))
    for _ in range(rounds):
        for r in _sums(source, books, scale, bits).collect():  # parts * entries * places rows at most
            books[r["part"], r["entry"], r["place"]] = r["total"] // r["n"]
    return books


def encode(vectors: DataFrame, books: np.ndarray, key: str = "vec_id", vector: str = "embedding", keep: tuple[str, ...] = (), scale: float = 4096.0, bits: int = BITS) -> DataFrame:
    """(key, keep..., code, error): for each vector that takes part the nearest entry
    of each part, and the sum of their squared distances."""
    parts, _, size = books.shape
    kept = [vectors[c].alias(f"__{i}") for i, c in enumerate(keep)]
    frame = vectors.select(vectors[key].cast("long").alias("__key"), vectors[vector].alias("__v"), *kept)

    def run(batches: Iterable[pa.RecordBatch]):
        files = [VAFile(b, bits) for b in books]
        for b in batches:
            x, at = _matrix(b.column(1), parts * size, scale)
            rows = b.take(pa.array(at))
            done = 0
            for _, entry, far in _assign(files, x):
                some = rows.slice(done, len(entry))
                codes = pa.array([r.tolist() for r in entry.astype(np.int32)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([some.column(0), *some.columns[2:], codes, pa.array(far.sum(axis=1))], names=["key", *[f"k{i}" for i in range(len(keep))], "code", "error"])
                done += len(entry)
        trimmed()

    kinds = dict(frame.dtypes)
    fields = ", ".join(["key long", *[f"k{i} {kinds[f'__{i}']}" for i in range(len(keep))], "code array<int>", "error long"])
    out = frame.mapInArrow(run, fields)
    return out.select(F.col("key").alias(key), *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "code", "error")


def decoded(code: Column, books: np.ndarray) -> Column:
    """The whole numbers that a code stands for."""
    table = F.array(*[F.array(*[F.array(*[F.lit(int(x)) for x in e]) for e in b]) for b in books])
    return F.flatten(F.transform(code, lambda e, p: table[p][e]))


def digest(books: np.ndarray) -> str:
    """Hex sha256 of all entries' components by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(codes: DataFrame, label: str = "label") -> DataFrame:
    """codes with label_error, the sum of error over equal labels."""
    totals = codes.groupBy(F.col(label).alias("__label")).agg(F.sum("error").alias("label_error"))
    totals = saved(totals, "labels")
    if totals.count() <= LABELS:
        return codes.join(F.broadcast(totals), F.col(label).eqNullSafe(F.col("__label"))).drop("__label")
    salted = totals.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    mine = codes.withColumn("__mine", F.pmod(F.xxhash64("error", "code"), F.lit(SALTS)).cast("int"))
    return mine.join(salted, F.col(label).eqNullSafe(F.col("__label")) & (F.col("__mine") == F.col("__salt"))).drop("__label", "__salt", "__mine")


def query(spark, sf_dir):
    from .common import table

    vectors = table(spark, sf_dir, "embeddings")
    books = fit(vectors)
    if books is None:
        empty = vectors.limit(0).select(F.col("vec_id").cast("long").alias("vec_id"), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return empty.withColumn("codebooks_sha256", F.lit(""))
    codes = saved(encode(vectors, books, keep=("label",)), "codes")
    text = F.array_join(F.transform("code", lambda e: F.format_string("%02x", e)), "")
    return with_label_error(codes).select("vec_id", text.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds as a chain of tables; e0 to e6 are the codebooks, a row an entry."""
    distance = "list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    nearest = f"SELECT x.vec_id, x.label, x.part, arg_min(struct_pack(entry := b.entry, v := x.v), struct_pack(d := {distance}, entry := b.entry)) AS best, CAST(min({distance}) AS BIGINT) AS d FROM x JOIN e{{}} b ON x.part = b.part GROUP BY x.vec_id, x.label, x.part"
    steps = []
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({nearest.format(r)})")
        steps.append(
            f"m{r} AS MATERIALIZED (SELECT part, entry, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS v FROM (SELECT part, best.entry AS entry, i, CAST(sum(best.v[i]) AS DOUBLE) AS s, count(*) AS n "
            f"FROM a{r}, (SELECT unnest(range(1, (SELECT max(len(v)) FROM x) + 1)) AS i) GROUP BY part, best.entry, i) GROUP BY part, entry)"
        )
        steps.append(f"e{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{r}.v, e{r}.v) AS v FROM e{r} LEFT JOIN m{r} USING (part, entry))")
    return f"""
WITH w AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS MATERIALIZED (
  SELECT vec_id, label, p AS part, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS v FROM w, range({parts}) t(p)
), e0 AS MATERIALIZED (
  SELECT part, entry, v FROM (SELECT part, v, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry FROM x) WHERE entry < {entries}
), {', '.join(steps)}, z AS MATERIALIZED ({nearest.format(rounds)}),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM e{rounds}),
c AS (SELECT vec_id, label, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM z GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c, h
"""


SQL = _sql()
