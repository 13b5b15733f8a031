"""Language-model scoring: interpolated modified Kneser-Ney bigrams.

Counting. Each task turns its texts into 48-bit word hashes, counts the bigrams
of a step of texts in arrays, and gives out one blob of counts for each slice
of the bigram hash, so counts are combined before the shuffle and a frequent
word's bigrams are spread over all slices. A slice stands for SLICE_BYTES of
training text; a shard is a run of slices and one set of files, of which there
are 2 ** MOST_BITS at most. A task reads its shards slice by slice in order of
the hash, merges one slice at a time in memory and appends it to the shard's
files, so a shard may be larger than memory. What words need (context totals,
continuation continuation types, counts) is merged by a second, much smaller shuffle over
shards of the word hash, whose tables are summed as they come: a task holds a shard's
distinct words, not its tables from all slices.

Two words share a hash with a probability of 2 ** -48: of V words about
V * V / 2 ** 49 pairs are counted as one (of a million words 0.002).

Scoring. Workers memory-map the sorted arrays from the shared folder, so the
model takes file cache and no heap; a step's bigrams are sorted, so each shard
is searched in order, and the MAPS files used last stay open. The model
directory must be a path that executors can map (spark.checkpoint.dir on a
mounted file system, or model_dir); other schemes are refused by name. The
model's description names every shard with its length, so a worker that finds a
file missing or short fails instead of scoring without it.

P(w | u) = max(c(u,w) - D(c), 0) / c(u) + g(u) * P(w)
P(w)     = max(t(w) - D'(t), 0) / T + g' / (V + 1)

with t(w) the number of kinds of words before w, T their sum, V the number of
different training tokens, and the discounts D1, D2, D3+ of Chen and Goodman
(1999) for each order. Bigrams are the order at which all counts of the corpus
fit the shuffle budget whole (see README); none is pruned.

Defined cases: null and empty texts have the end token only; without training
texts every probability is 1 / (V + 1) = 1; unseen words have the unseen share
of P(w); repeated rows count and are scored each, null ids too; other columns
don't matter, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import os
import uuid
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, new_path, remainder, trimmed

END, START = 1, 2
MASK = np.uint64((1 << 48) - 1)
#: Tokens that are counted, and that are scored, in arrays at a time.
COUNT_TOKENS, SCORE_TOKENS = 2_000_000, 500_000
#: Bytes of training text a slice; bits of the slice's and of the shard's number at most.
SLICE_BYTES, SLICE_BITS, MOST_BITS = 16 << 20, 18, 12
#: Entries of tables of words that are held before they are summed.
FOLD_ENTRIES = 250_000
#: Files that a worker keeps mapped.
MAPS = 512
TABLE_ENTRIES = 200_000
#: Counts from here on are kept apart.
MANY = 255
WORD_FIELDS = ("total", "n1", "n2", "n3", "types", "count")


class Hasher:
    """48-bit hashes of words, distinct words hashed once."""

    def __init__(self):
        import xxhash

        self.digest, self.table = xxhash.xxh64_intdigest, {}

    def __call__(self, words: list[bytes]) -> list[int]:
        try:
            return list(map(self.table.__getitem__, words))
        except KeyError:
            if len(self.table) > TABLE_ENTRIES:
                self.table.clear()
            for w in set(words):
                if w not in self.table:
                    self.table[w] = max(3, self.digest(w, 7) & int(MASK))
            return list(map(self.table.__getitem__, words))


def _steps(texts, hasher, most):
    """(sequence of hashes, end of each text): START w1 .. wn END for each text."""
    held, ends = [], []
    for t in texts:
        held.append(START)
        # bytes.lower() and bytes.split() know A-Z and the six ASCII white-space characters only.
        held += hasher((t.as_py() or "").encode().lower().split())
        held.append(END)
        ends.append(len(held))
        if len(held) > most:
            step = [(np.array(held, np.uint64), np.array(ends))]
            held, ends = [], []
            yield step.pop()  # the caller's alone: it may give the arrays up
    if ends:
        yield np.array(held, np.uint64), np.array(ends)


def bigram_hash(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = u * np.uint64(0x9E3779B97F4A7C15) + w
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def _six(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel().astype(np.uint64)


def _summed(keys: np.ndarray, *values: np.ndarray):
    """Sorted distinct keys with the sums of their values, and the first place of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[first], [np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values], order[first]


def _squeezed(table: np.ndarray) -> bytes:
    return len(table.tobytes()).to_bytes(8, "little") + pa.compress(table.astype("<i8").tobytes(), codec="zstd", asbytes=True)


def _loosened(b: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(b[8:], int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True), "<i8")


def _local(path: str) -> str:
    scheme, found, rest = path.partition(":")
    if not found or path.startswith("/"):
        return path
    if scheme != "file":
        raise ValueError(f"the model is memory-mapped: {scheme}: is not a path that executors can map; give model_dir")
    return "/" + rest.lstrip("/")


class Files:
    """Arrays that grow by parts; close() puts them in place whole, so that a
    repeated or speculative task replaces them."""

    def __init__(self, folder: str, names: dict[str, str]):
        os.makedirs(folder, exist_ok=True)
        self.parts = {n: f"{folder}/.{n}-{uuid.uuid4().hex}" for n in names}
        self.final = {n: f"{folder}/{n}" for n in names}
        self.kinds, self.open = names, {n: open(p, "wb") for n, p in self.parts.items()}

    def add(self, name: str, array: np.ndarray) -> None:
        array.astype(self.kinds[name]).tofile(self.open[name])

    def close(self) -> None:
        for n, f in self.open.items():
            f.close()
            os.replace(self.parts[n], self.final[n])


def _count(bits: int, shard_bits: int):
    def run(batches):
        hasher = Hasher()
        # Steps go on over batches: the larger a step, the more it combines.
        for seq, _ in _steps((t for b in batches for t in b.column(0)), hasher, COUNT_TOKENS):
            u, w = seq[:-1], seq[1:]
            real = u != END
            u, w = u[real], w[real]
            del seq, real  # what is used up goes before the next arrays are made
            h = bigram_hash(u, w)
            order = np.argsort(h, kind="stable")
            h = h[order]
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            c = np.diff(np.r_[first, len(h)])
            cut, first = (h[first] >> np.uint64(64 - bits)).astype(np.int64), order[first]
            del h, order
            u, w = u[first], w[first]
            del first
            starts = np.flatnonzero(np.r_[True, cut[1:] != cut[:-1]])
            rows = list(zip(cut[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(cut)]))
            yield pa.RecordBatch.from_arrays([pa.array([k >> (bits - shard_bits) for k, _, _ in rows], pa.int32()), pa.array([k for k, _, _ in rows], pa.int32()), *(pa.array(x, pa.binary()) for x in zip(*[(_six(u[a:z]), _six(w[a:z]), c[a:z].astype("<u4").tobytes()) for _, a, z in rows]))], names=["shard", "slice", "u", "w", "c"])
        trimmed()

    return run


def _slices(batches):
    """(shard, slice, columns of its blobs) of sorted batches."""
    held, now = [], None
    for b in batches:
        cut = b.column("slice").to_numpy()
        edges = np.flatnonzero(np.r_[True, cut[1:] != cut[:-1]]).tolist() if len(cut) else []
        for a, z in zip(edges, [*edges[1:], len(cut)]):
            key = (b.column("shard")[a].as_py(), int(cut[a]))
            if held and key != now:
                yield *now, held
                held = []
            now = key
            held.append(b.slice(a, z - a))
    if held:
        yield *now, held


def _merge(folder: str, part_bits: int):
    """Merge sorted blobs slice by slice into shard files; gives out the tables
    of words of each slice (part >= 0), counts of counts (-1) and lengths (-2)."""
    kinds = {"h": "<u8", "c": "u1", "m": "<i8"}

    def run(batches):
        files, shard, size = None, None, 0
        for k, _, blobs in _slices(batches):
            if k != shard:
                if files:
                    files.close()
                    yield made([(-2, b"", _squeezed(np.array([shard, size])))])
                files, shard, size = Files(folder, {f"g{k}{n}": t for n, t in kinds.items()}), k, 0
            rows, n = merged(blobs, files, k, size)
            size += n
            yield made(rows)
        if files:
            files.close()
            yield made([(-2, b"", _squeezed(np.array([shard, size])))])
        trimmed()

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["part", "word", "table"])

    def merged(blobs, files, shard, at):
        column = lambda name: b"".join(x for b in blobs for x in b.column(name).to_pylist())
        u, w = _from_six(column("u")), _from_six(column("w"))
        c = np.frombuffer(column("c"), "<u4").astype(np.int64)
        h, (c,), first = _summed(bigram_hash(u, w), c)
        u, w = u[first], w[first]
        # One byte a count; the few counts above it stand apart with their places.
        many = np.flatnonzero(c >= MANY)
        files.add(f"g{shard}h", h)
        files.add(f"g{shard}c", np.minimum(c, MANY))
        files.add(f"g{shard}m", np.stack([many + at, c[many]], axis=1))
        one = lambda k: (c == k).astype(np.int64)
        words, context, _ = _summed(u, c, one(1), one(2), (c > 2).astype(np.int64))
        after, (types, count), _ = _summed(w, np.ones(len(c), np.int64), c)
        every = np.unique(np.r_[words, after])
        table = np.zeros((6, len(every)), np.int64)
        table[:4, np.searchsorted(every, words)] = context
        table[4:, np.searchsorted(every, after)] = types, count
        part = (every >> np.uint64(48 - part_bits)).astype(np.int64)
        cuts = np.searchsorted(part, np.arange((1 << part_bits) + 1))
        rows = [(k, _six(every[a:z]), _squeezed(table[:, a:z])) for k, (a, z) in enumerate(zip(cuts, cuts[1:])) if a < z]
        return [*rows, (-1, b"", _squeezed(np.array([(c == k).sum() for k in (1, 2, 3, 4)])))], len(h)

    return run


class _Folded:
    """Tables (words, fields) that are summed as they come: what is held are the distinct words so far
    and at most as many entries again (FOLD_ENTRIES at least), not the tables of all slices."""

    def __init__(self):
        self.keys, self.table = np.empty(0, np.uint64), [np.empty(0, np.int64)] * len(WORD_FIELDS)
        self.held, self.n = [], 0

    def add(self, keys: np.ndarray, table: np.ndarray) -> None:
        self.held.append((keys, table))
        self.n += len(keys)
        if self.n > max(FOLD_ENTRIES, len(self.keys)):
            self.fold()

    def fold(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.held)])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
        self.keys = keys[first]
        if len(first):  # a field at a time, so that no second copy of all fields is made
            for i in range(len(self.table)):
                self.table[i] = np.add.reduceat(np.concatenate([self.table[i], *(t[i] for _, t in self.held)])[order], first)
        self.held, self.n = [], 0


def _words(folder: str):
    """Merge the tables of words of sorted parts, one table at a time; part -2 lists shards and lengths."""

    def stored(part: int, found: _Folded) -> np.ndarray:
        found.fold()
        files = Files(folder, {f"w{part}h": "<u8", f"w{part}t": "<i8"})
        files.add(f"w{part}h", found.keys)
        for a in range(0, len(found.keys), FOLD_ENTRIES):
            files.add(f"w{part}t", np.stack([x[a : a + FOLD_ENTRIES] for x in found.table], axis=1))
        files.close()
        types, count = found.table[4], found.table[5]
        return np.array([*((types == k).sum() for k in (1, 2, 3, 4)), types.sum(), count.sum(), (count > 0).sum(), len(found.keys)])

    def run(batches):
        part, found = None, None

        def ended():
            stats = stored(part, found) if part >= 0 else found
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([stats.tolist()], pa.list_(pa.int64()))], names=["part", "stats"])

        for b in batches:
            for k, word, table in zip(b.column("part").to_pylist(), b.column("word"), b.column("table")):
                if k != part:
                    if part is not None:
                        yield ended()
                    part, found = k, _Folded() if k >= 0 else np.zeros(8 if k == -1 else 0, np.int64)
                if k == -2:
                    found = np.concatenate([found, _loosened(table.as_py())])
                elif k == -1:
                    found[:4] += _loosened(table.as_py())
                else:
                    found.add(_from_six(word.as_py()), _loosened(table.as_py()).reshape(len(WORD_FIELDS), -1))
        if part is not None:
            yield ended()
        trimmed()

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """D1, D2, D3+ of modified Kneser-Ney; 0.5, 1, 1.5 where counts are missing."""
    if not (n1 and n2):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), d))


def train(docs: DataFrame, text: str = "text", model_dir: str | None = None) -> dict:
    """Count the texts of docs and store the model; returns its description
    (folder, lengths of shards, totals), which is all that is sent to workers."""
    folder = _local(model_dir or new_path(docs.sparkSession, "lm"))
    frame = bounded_batches(docs).select(F.col(text).cast("string").alias("t"))
    size = frame.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    bits = min(SLICE_BITS, max(3, math.ceil(math.log2(size / SLICE_BYTES + 1))))
    shard_bits = min(bits, MOST_BITS)
    part_bits = max(1, shard_bits - 3)
    blobs = frame.mapInArrow(_count(bits, shard_bits), "shard int, slice int, u binary, w binary, c binary")
    merged = blobs.repartition(1 << shard_bits, "shard").sortWithinPartitions("shard", "slice").mapInArrow(_merge(folder, part_bits), "part int, word binary, table binary")
    rows = merged.repartition(1 << part_bits, "part").sortWithinPartitions("part").mapInArrow(_words(folder), "part int, stats array<long>").collect()
    of = lambda k: sum(r["stats"][k] for r in rows if r["part"] >= 0)
    two = next((r["stats"][:4] for r in rows if r["part"] == -1), [0, 0, 0, 0])
    pairs = next((r["stats"] for r in rows if r["part"] == -2), [])
    lengths = {f"g{k}": n for k, n in zip(pairs[::2], pairs[1::2])} | {f"w{r['part']}": r["stats"][7] for r in rows if r["part"] >= 0}
    return {"folder": folder, "bits": shard_bits, "part_bits": part_bits, "lengths": lengths, "d": discounts(*two), "d_low": discounts(*map(of, range(4))), "low": [of(k) for k in range(4)], "types": of(4), "tokens": of(5), "vocabulary": of(6)}


class Model:
    """A worker's view of a stored model."""

    def __init__(self, about: dict):
        self.about, self.files = about, OrderedDict()

    def _map(self, name: str, kind: str, width: int = 1) -> np.ndarray:
        """A file's array; only MAPS of them stay mapped."""
        if name in self.files:
            self.files.move_to_end(name)
            return self.files[name]
        path = f"{self.about['folder']}/{name}"
        if not os.path.exists(path):
            raise FileNotFoundError(f"the model's file {path} is gone, or the folder is not mounted here")
        found = np.memmap(path, kind, "r") if os.path.getsize(path) else np.empty(0, kind)
        self.files[name] = found.reshape(-1, width) if width > 1 else found
        if len(self.files) > MAPS:
            self.files.popitem(last=False)
        return self.files[name]

    def _found(self, kind: str, keys: np.ndarray, shift: int):
        """For sorted keys: (shard, slice, places, hits), shard by shard."""
        of = (keys >> np.uint64(shift)).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else []
        for a, z in zip(starts, [*starts[1:], len(of)]):
            k = int(of[a])
            n = self.about["lengths"].get(f"{kind}{k}", 0)
            if n:
                h = self._map(f"{kind}{k}h", "<u8")
                if len(h) != n:
                    raise ValueError(f"the model's shard {kind}{k} has {len(h)} entries, not {n}")
                at = np.minimum(np.searchsorted(h, keys[a:z]), n - 1)
                yield k, slice(a, z), at, h[at] == keys[a:z]

    def words(self, keys: np.ndarray) -> np.ndarray:
        """WORD_FIELDS of sorted word hashes, zeros for unseen ones."""
        out = np.zeros((len(keys), 6), np.int64)
        for k, s, at, hit in self._found("w", keys, 48 - self.about["part_bits"]):
            out[s][hit] = self._map(f"w{k}t", "<i8", 6)[at[hit]]
        return out

    def bigrams(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted bigram hashes."""
        out = np.zeros(len(keys), np.int64)
        for k, s, at, hit in self._found("g", keys, 64 - self.about["bits"]):
            c = self._map(f"g{k}c", "u1")[at[hit]].astype(np.int64)
            if (high := np.flatnonzero(c == MANY)).size:
                many = self._map(f"g{k}m", "<i8", 2)
                c[high] = many[np.searchsorted(many[:, 0], at[hit][high]), 1]
            out[s][hit] = c
        return out

    def score(self, seq: np.ndarray, ends: np.ndarray):
        """For each text: tokens, known tokens, base score, model score."""
        m = self.about
        kinds, place = np.unique(seq, return_inverse=True)
        table = self.words(kinds)
        total, n1, n2, n3, types, count = table.T
        n, v = m["tokens"], m["vocabulary"]
        base = np.log10((count + 0.1) / (n + 0.1 * (v + 1)))
        d = np.array([0.0, *m["d"]])
        low = np.array([0.0, *m["d_low"]])
        if m["types"]:
            t1, t2, _, _ = m["low"]
            many = self.about["vocabulary"] - t1 - t2
            left = (low[1] * t1 + low[2] * t2 + low[3] * many) / m["types"]
            p_low = np.maximum(types - low[np.minimum(types, 3)], 0) / m["types"] + left / (v + 1)
        else:
            p_low = np.full(len(kinds), 1 / (v + 1))
        back = np.where(total > 0, (d[1] * n1 + d[2] * n2 + d[3] * n3) / np.maximum(total, 1), 1.0)
        u, w = place[:-1], place[1:]
        real = seq[:-1] != END
        u, w = u[real], w[real]
        h = bigram_hash(kinds[u], kinds[w])
        order = np.argsort(h)
        c = np.empty(len(h), np.int64)
        c[order] = self.bigrams(h[order])
        p = np.maximum(c - d[np.minimum(c, 3)], 0) / np.maximum(total[u], 1) + back[u] * p_low[w]
        # Tokens of a text: everything but its START.
        first = np.r_[0, ends[:-1]] - np.arange(len(ends))
        add = lambda x: np.add.reduceat(x, first)
        return np.diff(np.r_[0, ends]) - 1, add((count[w] > 0).astype(np.int64)), add(base[w]), add(np.log10(p))


def score_texts(docs: DataFrame, about: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) of each whole text."""

    def run(batches):
        hasher, model = Hasher(), Model(about)
        for b in batches:
            at = 0
            for seq, ends in _steps(b.column(1), hasher, SCORE_TOKENS):
                n, known, base, score = model.score(seq, ends)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(ends)), pa.array(n, pa.int64()), pa.array(known), pa.array(np.full(len(n), about["tokens"], np.int64)), pa.array(base), pa.array(score)], names=[key, "n_tokens", "n_known", "train_tokens", "base_score", "score"])
                at += len(ends)
        trimmed()

    frame = bounded_batches(docs).select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text))
    return frame.mapInArrow(run, f"`{key}` long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark, sf_dir):
    from .common import table

    docs = table(spark, sf_dir, "documents")
    about = train(docs.where(remainder(F.col("doc_id"), 10) != 0))
    out = score_texts(docs, about)
    return out.select("doc_id", (remainder(F.col("doc_id"), 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
