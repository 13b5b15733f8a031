"""Exact top-k inner products by no-random-access aggregation.

The candidates are dealt into blocks, and queries go to every block. For a query, each dimension of a block is a list: the block's vectors sorted by
their contribution to the score, from the list's top where the query's component
is positive and from its bottom where it is negative (zero components have no
list). The NRA algorithm (Fagin, Lotem and Naor, 2001) reads all lists in step:

- only list entries that have been reached are used, and each is added once;
- a vector met has a lower bound (what is known of it, and the worst value of
  each list that has not shown it) and an upper bound (the same with the last
  value read there); all vectors not met, the outsiders, share one upper bound,
  the sum of the last values read;
- once that lies below the k-th best lower bound, outsiders cannot qualify, and
  those met whose upper bound lies below it are dropped as well;
- a query stops when few are left (RESOLVE * k, or an eighth of what the lists have
  left), and their final scores are resolved.

Which entries a step adds depends on a query's signs only, so a step of STEP
queries is a product of their components with the entries just reached; queries
leave it one by one as they stop. The k-th best of the blocks that a task has read
before for the same queries counts as a bound from the start, so later blocks are
read less deep. nra() returns the depths it read to.

Each query meets each block of candidates (a stated query set against all rows): a
candidate moves once and its block's lists are sorted once. A task keeps k rows a
query for the blocks that it reads, and one ranking merges the tasks. No pair of
vectors is ever a row, and nothing is joined.

Components are whole numbers, and sums stay exact: in doubles below 2 ** 53,
else in 64-bit integers.

Defined cases: null vectors and those with null, NaN or infinite components (or,
against a query, of another length), empty vectors and null ids take no part;
rows that repeat an id are candidates each, but never of their own id; of query
rows that repeat an id the one whose vector sorts first is asked; ties go to the
smaller id; with fewer than k candidates all are given; other columns don't
matter, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, trimmed

#: Components of a block of candidates, and queries whose best a task holds at most.
BLOCK, QUERIES = 1 << 18, 100_000
#: Entries of each list that the first step reads; every step doubles the depth.
FIRST, RESOLVE = 64, 8
#: Queries that are read for together.
STEP = 256


class Lists:
    """A block of vectors and its lists: the values of each dimension in ascending
    order, and the place of each vector there."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.vectors, self.ids = vectors, ids
        self.most = int(max(-int(vectors.min(initial=0)), int(vectors.max(initial=0))))
        order = np.argsort(vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(vectors, order, axis=0)
        self.place = np.empty(order.shape, np.int32)
        np.put_along_axis(self.place, order, np.broadcast_to(np.arange(len(vectors), dtype=np.int32)[:, None], order.shape), axis=0)


def nra(queries: np.ndarray, lists: Lists, own: np.ndarray, k: int, least: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """For each query (rows, scores, depth): its k best vectors of a block, best
    first, other than those with the id `own`, and how many entries of each list
    were read.

    least: for each query a score that k vectors of other blocks reach already
    (-inf: none)."""
    n, out = len(lists.vectors), [None] * len(queries)
    exact = lists.most * int(np.abs(queries).sum(axis=1).max(initial=0)) < 2**53
    kind = np.float64 if exact else np.int64
    none = -np.inf if exact else np.iinfo(np.int64).min
    v, values = lists.vectors.astype(kind), lists.sorted.astype(kind)
    plus, minus = np.maximum(queries, 0).astype(kind), np.minimum(queries, 0).astype(kind)
    least = np.full(len(queries), none, kind) if least is None else np.where(np.isfinite(least), least, none).astype(kind)
    mine = lists.ids[None, :] != np.asarray(own)[:, None]
    active, known, depth = np.arange(len(queries)), np.zeros((len(queries), n), kind), 0

    def product(top, bottom, rows=slice(None)):
        """Sums over the lists of active queries of what the tops and bottoms hold."""
        return plus[active] @ top[rows].T + minus[active] @ bottom[rows].T

    while depth < n and len(active):
        start, depth = depth, min(n, depth + max(FIRST, depth))
        hidden = lists.place < n - depth, lists.place >= depth
        new = (lists.place < n - start) & ~hidden[0], (lists.place >= start) & ~hidden[1]
        rows = np.flatnonzero((new[0] | new[1]).any(axis=1))
        known[:, rows] += product(v * new[0], v * new[1], rows)
        if n > k:
            lower = np.where(mine[active], known + product(hidden[0] * values[0], hidden[1] * values[-1]), none)
            least[active] = np.maximum(least[active], np.partition(lower, n - k, axis=1)[:, n - k])
        last = values[n - depth], values[depth - 1]
        closed = np.flatnonzero(plus[active] @ last[0] + minus[active] @ last[1] < least[active])
        done = np.zeros(len(active), bool)
        if len(closed) and depth < n:
            at = active[closed]
            upper = known[closed] + plus[at] @ (hidden[0] * last[0]).T + minus[at] @ (hidden[1] * last[1]).T
            live = (upper >= least[at, None]) & mine[at]
            few = live.sum(axis=1) <= max(RESOLVE * k, (n - depth) // 8)
            for i in np.flatnonzero(few):
                out[at[i]] = (*_best(queries[at[i]], lists, np.flatnonzero(live[i]), k), depth)
            done[closed[few]] = True
        active, known = active[~done], known[~done]
    for i in active:
        out[i] = (*_best(queries[i], lists, np.flatnonzero(mine[i]), k), depth)
    return out


def _best(query: np.ndarray, lists: Lists, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The final scores of those left: (rows, scores) of the k best."""
    score = (lists.vectors[rows].astype(np.int64) @ query.astype(np.int64)).astype(np.int64)
    if len(rows) > k:
        near = score >= np.partition(score, len(score) - k)[len(score) - k]
        rows, score = rows[near], score[near]
    order = np.lexsort((lists.ids[rows], -score))[:k]
    return rows[order], score[order]


class Best:
    """The k best (score, id) of queries over the candidate blocks that a task reads."""

    def __init__(self, k: int):
        self.k, self.held = k, {}

    def meet(self, lists: Lists, ids: np.ndarray, vectors: np.ndarray) -> None:
        found = [self.held.get(i, []) for i in ids.tolist()]
        least = np.array([-h[-1][0] if len(h) == self.k else -np.inf for h in found])
        for i, h, (rows, scores, _) in zip(ids.tolist(), found, nra(vectors, lists, ids, self.k, least)):
            self.held[i] = sorted(h + list(zip((-scores).tolist(), lists.ids[rows].tolist())))[: self.k]

    def batch(self) -> pa.RecordBatch:
        rows = [(q, i, -s) for q, held in self.held.items() for s, i in held]
        self.held = {}
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], names=["query_id", "vec_id", "score"])


def _components(frame: DataFrame) -> int:
    return frame.agg(F.sum("dim")).first()[0] or 0


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best vectors of each query; the
    vectors hold whole numbers."""

    def clean(df):
        v = F.col(vector).cast("array<long>")
        return df.select(F.col(key).cast("long").alias("id"), v.alias("v"), F.size(v).alias("dim")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()) & (F.col("dim") > 0))

    candidates = clean(vectors)
    asked = clean(queries).groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    # Each candidate block meets each query (a stated query set against all rows): a candidate moves once, to its
    # block, by its id and place, so that an id with very many rows is spread like any others; queries go to all blocks.
    blocks = max(1, -(-_components(candidates) // BLOCK))
    own = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    rows = candidates.select("dim", own.alias("block"), F.lit(0).alias("asks"), "id", "v").unionByName(asked.select("dim", every.alias("block"), F.lit(1).alias("asks"), "id", "v"))
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = rows.repartition(n, "dim", "block").sortWithinPartitions("dim", "block", "asks", "id")

    def arrays(parts, dim):
        ids = np.concatenate([np.asarray(p.column("id")) for p in parts])
        return ids, np.concatenate([np.asarray(p.column("v").flatten()) for p in parts]).reshape(-1, dim)

    def run(batches):
        best, now, held, lists = Best(k), None, [], None
        for b in batches:
            place = [np.asarray(b.column(c)) for c in ("dim", "block", "asks")]
            cuts = [0, *(np.flatnonzero(np.any([p[1:] != p[:-1] for p in place], axis=0)) + 1).tolist(), b.num_rows]
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                dim, block, asks = (int(p[start]) for p in place)
                if now != (dim, block):
                    now, held, lists = (dim, block), [], None
                part = b.slice(start, end - start)
                if not asks:
                    held.append(part)
                    continue
                if not held:
                    continue  # no candidate of this length is in the block
                if lists is None:
                    ids, v = arrays(held, dim)
                    lists = Lists(v, ids)
                for at in range(0, end - start, STEP):
                    best.meet(lists, *arrays([part.slice(at, STEP)], dim))
                if len(best.held) > QUERIES:
                    yield best.batch()
        if best.held:
            yield best.batch()
        trimmed()

    found = saved(met.mapInArrow(run, "query_id long, vec_id long, score long"), "topk")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantized(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(key, vector) with each component x as floor(scale * x); vectors that are
    null or hold null, NaN or infinite components are left out."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = F.col(vector).cast("array<double>")
    return vectors.select(F.col(key).cast("long").alias(key), v.alias(vector)).where(F.col(vector).isNotNull() & ~F.exists(vector, bad)).withColumn(vector, F.transform(vector, lambda x: F.floor(x * scale)))


def query(spark, sf_dir):
    from .common import table

    whole = quantized(table(spark, sf_dir, "embeddings"))
    return top_k(whole, whole.where(F.pmod("vec_id", F.lit(50)) == 0))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
