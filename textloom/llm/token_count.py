"""Token counts by rank-synchronous array merging.

A text is cut into pre-tokens (marked words: no piece crosses a white-space
marker). The distinct pre-tokens of a batch are held as one ragged array of
symbol ids; in each round every sequence finds its lowest-rank adjacent pair
(the leftmost of equals) and all sequences merge theirs at the same time,
until no pair is left. What survives is counted: a piece is one token, a
character outside the vocabulary as many as it has UTF-8 bytes. Counts of
distinct pre-tokens are kept in a bounded table and added up by position.

A pre-token of over LONG characters, where a merge a round would be quadratic,
is merged by the same rule with a heap.

Defined cases: null and empty texts have no tokens; strings of control tokens
inside a text are ordinary characters, as the library has it; repeated rows and
null ids give a row each; other columns don't matter, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, trimmed
from .pieces import MARK, TABLE_ENTRIES, check_model, chunk_keys, default_model, steps

LONG = 400


class MergeTable:
    """Pairs of symbols that merge, with their ranks, as sorted arrays."""

    def __init__(self, model: str | None = None):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model or default_model())
        check_model(sp)
        special = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
        pieces = {sp.id_to_piece(i): (sp.get_score(i), i) for i in range(sp.vocab_size()) if not special(i)}
        order = {p: r for r, p in enumerate(sorted(set(s for s, _ in pieces.values()), reverse=True))}
        chars = sorted({c for p in pieces for c in p})
        self.symbols = list(pieces) + [c for c in chars if c not in pieces]
        self.id = {s: i for i, s in enumerate(self.symbols)}
        self.n_pieces = len(pieces)
        #: Tokens of each symbol; ids from len(symbols) on are characters unknown to all pieces.
        self.tokens = np.array([1] * len(pieces) + [len(c.encode()) for c in self.symbols[len(pieces) :]], np.int64)
        rows = [(self.id[p[:k]], self.id[p[k:]], order[pieces[p][0]], self.id[p]) for p in pieces if len(p) > 1 for k in range(1, len(p)) if p[:k] in self.id and p[k:] in self.id]
        a = np.array(sorted(rows, key=lambda r: (r[0], r[1])), np.int64).reshape(-1, 4)
        self.key, self.rank, self.to = (a[:, 0] << 32) | a[:, 1], a[:, 2], a[:, 3]
        self.pair = {int(k): (int(r), int(t)) for k, r, t in zip(self.key, self.rank, self.to)}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (none: the largest integer) and its place in the table."""
        k = (left << 32) | right
        at = np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)
        return np.where(self.key[at] == k, self.rank[at], np.iinfo(np.int64).max), at

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token (marker included, not empty)."""
        out = np.zeros(len(words), np.int64)
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        for i in range(len(words)):
            if len(words[i]) > LONG:
                out[i] = self._count_long(words[i])
        if not short:
            return out
        get, base = self.id.get, len(self.symbols)
        flat = "".join([words[i] for i in short])
        # Characters unknown to all pieces never merge; their byte count rides in the id.
        sym = np.fromiter((get(c, -1) for c in flat), np.int64, len(flat))
        odd = np.flatnonzero(sym < 0)
        sym[odd] = [base + len(flat[i].encode()) for i in odd]
        owner = np.repeat(np.arange(len(short)), [len(words[i]) for i in short])
        cost = lambda s: np.where(s < base, self.tokens[np.minimum(s, base - 1)], s - base)
        total, none = np.zeros(len(short), np.int64), np.iinfo(np.int64).max
        r, at = self.ranks(sym[:-1], sym[1:]) if len(sym) > 1 else (np.empty(0, np.int64), np.empty(0, np.int64))
        while len(sym):
            rank = np.full(len(sym), none)
            if len(sym) > 1:
                r, at = self.ranks(sym[:-1], sym[1:])
                rank[:-1] = np.where(owner[:-1] == owner[1:], r, none)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(rank, starts)
            size = np.diff(np.r_[starts, len(sym)])
            ended = np.repeat(lowest == none, size)
            if ended.any():  # these sequences are whole: count them and let them go
                np.add.at(total, owner[ended], cost(sym[ended]))
            going = ~ended
            if not going.any():
                break
            best = np.flatnonzero((rank == np.repeat(lowest, size)) & going)
            first = best[np.r_[True, owner[best][1:] != owner[best][:-1]]]
            sym[first] = self.to[at[first]]
            going[first + 1] = False
            sym, owner = sym[going], owner[going]
        out[short] = total
        return out

    def _count_long(self, word: str) -> int:
        base = len(self.symbols)
        sym = [self.id.get(c, base + len(c.encode())) for c in word]
        nxt, prv = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        heap = []

        def push(i):
            j = nxt[i]
            if 0 <= i and j < len(sym) and (hit := self.pair.get((sym[i] << 32) | sym[j])):
                heapq.heappush(heap, (hit[0], i, sym[i], sym[j], hit[1]))

        for i in range(len(sym) - 1):
            push(i)
        while heap:
            _, i, a, b, to = heapq.heappop(heap)
            j = nxt[i]
            if sym[i] != a or j >= len(sym) or sym[j] != b:
                continue
            sym[i], sym[j], nxt[i] = to, -1, nxt[j]
            if nxt[j] < len(sym):
                prv[nxt[j]] = i
            push(i)
            if prv[i] >= 0:
                push(prv[i])
        return sum(int(self.tokens[s]) if s < base else s - base for s in sym if s >= 0)


def count_tokens(docs: DataFrame, model: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens) of each whole text."""
    frame = bounded_batches(docs).select(docs[key].cast("long").alias(key), F.coalesce(docs[text].cast("string"), F.lit("")).alias(text))

    def run(batches):
        merges, table = MergeTable(model), {}
        for b in batches:
            counts, sizes = [], []
            for part in steps(b.column(1)):
                keys = [chunk_keys(t) if t else [] for t in part]
                if len(table) > TABLE_ENTRIES:
                    table.clear()
                new = [k for k in set().union(*keys) if k not in table]
                table.update(zip(new, merges.count([MARK + k.replace(" ", MARK) for k in new]).tolist()))
                get = table.__getitem__
                counts += [sum(map(get, ks)) for ks in keys]
                sizes += [len(t.encode()) for t in part]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=[key, "n_bytes", "n_tokens"])
        trimmed()

    return frame.mapInArrow(run, f"`{key}` long, n_bytes long, n_tokens long")


def query(spark, sf_dir, limit: int = 4096):
    from .common import table

    out = count_tokens(table(spark, sf_dir, "documents"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
