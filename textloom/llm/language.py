"""Language identification by prediction by partial matching.

Each language has a byte context tree up to ORDER bytes deep, learned from
labelled texts and then frozen. A byte's code length in a language is that of
the longest context seen with it there; each longer context that was seen
without it adds its escape (method C: after n bytes of q kinds, the escape has
probability q / (n + q)), and below the empty context all 256 bytes are alike.
The language whose model gives the text the shortest exact code is predicted.

The coded sequence is the whole text, lower-cased and with each ASCII digit as
0, in UTF-8: letters, digits, signs and white space, each byte in the context of
the ORDER bytes before it (before the text: line feeds). As the statistics are frozen, a byte's code
length is a function of its ORDER + 1 bytes, so a worker keeps those it has
computed in a table of bounded size and looks each position of a text up there.

The trees of all languages are stored as one sorted array of contexts and one
of (context, byte) for each depth, with a column a language. Their size is
bounded by the learning sample: at most SAMPLE labelled texts a language, those
with the smallest hash of their id, whole, of the LANGUAGES most frequent ones.

Defined cases: a null text or one without a letter (general category L) is
`und` with score 0; a null lang is not learned from; rows that repeat an id in a
language are learned from once (the text that sorts first); repeated rows are
predicted each; equal code lengths go to the smaller language name; if nothing
can be learned every text is `und`; an empty table gives an empty result; other
columns of the table pass through whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, remainder, trimmed

ORDER = 4
SAMPLE, LANGUAGES = 600, 256
UND = "und"
#: Bytes of a worker's table of code lengths, and positions that are coded at a time.
TABLE_BYTES, STEP = 96 << 20, 1 << 18
_MIX = np.uint64(0x9E3779B97F4A7C15)


#: Which digit it is tells no language.
_DIGITS = bytes.maketrans(b"123456789", b"000000000")


def coded(text: str) -> bytes:
    return text.lower().encode().translate(_DIGITS)


def has_letter(text: str | None) -> bool:
    """str.isalpha() is true of the general category L and of nothing else."""
    return bool(text) and any(map(str.isalpha, text))


def grams(data: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The depth + 1 bytes that end at each place, as an integer (of at most 8 bytes)."""
    out = np.zeros(len(at), np.uint64)
    for k in range(depth, -1, -1):
        out = (out << np.uint64(8)) | data[at - k]
    return out


def laid_out(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the texts, each after `order` line feeds; the places of coded
    bytes; and where each text's places begin."""
    pad = b"\n" * order
    size = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(size) - size
    at = np.arange(size.sum()) + np.repeat(order * np.arange(1, len(texts) + 1), size)
    return np.frombuffer(b"".join([pad + t for t in texts]), np.uint8).astype(np.uint64), at, first


class ContextTrees:
    """Frozen statistics of all languages."""

    def __init__(self, samples: dict[str, list[bytes]], order: int = ORDER):
        self.langs, self.order = sorted(samples), order
        self.grams, self.costs, self.contexts, self.escapes = [], [], [], []
        laid = [laid_out(samples[lang], order)[:2] for lang in self.langs]
        for depth in range(order + 1):
            found = [np.unique(grams(data, at, depth), return_counts=True) for data, at in laid]
            kinds = np.unique(np.concatenate([g for g, _ in found])) if found else np.empty(0, np.uint64)
            contexts = np.unique(kinds >> np.uint64(8))
            cost = np.full((len(kinds), len(found)), np.nan)
            escape = np.zeros((len(contexts), len(found)))
            for k, (g, n) in enumerate(found):
                where = np.searchsorted(contexts, g >> np.uint64(8))
                total, q = np.bincount(where, n, len(contexts)), np.bincount(where, minlength=len(contexts))
                seen = total > 0
                cost[np.searchsorted(kinds, g), k] = -np.log2(n / (total + q)[where])
                escape[seen, k] = -np.log2(q[seen] / (total + q)[seen])
            self.grams.append(kinds)
            self.costs.append(cost)
            self.contexts.append(contexts)
            self.escapes.append(escape)
        # A gram that a language lacks costs its escape and the gram one byte shorter; fill in from the short ones.
        for depth in range(order + 1):
            g = self.grams[depth]
            lower = self.lengths(g & np.uint64((1 << (8 * depth)) - 1), depth - 1) if depth else np.full((len(g), len(self.langs)), 8.0)
            lower = lower + self._escape(depth, g)
            self.costs[depth] = np.where(np.isnan(self.costs[depth]), lower, self.costs[depth])

    def _escape(self, depth: int, code: np.ndarray) -> np.ndarray:
        keys, out, wanted = self.contexts[depth], np.zeros((len(code), len(self.langs))), code >> np.uint64(8)
        if len(keys):
            place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            hit = keys[place] == wanted
            out[hit] = self.escapes[depth][place[hit]]
        return out

    def lengths(self, code: np.ndarray, depth: int | None = None) -> np.ndarray:
        """Code length in bits of the last byte of each gram, a column a language."""
        depth = self.order if depth is None else depth
        out, left = np.zeros((len(code), len(self.langs))), np.arange(len(code))
        while depth >= 0 and len(left):
            keys = self.grams[depth]
            place = np.minimum(np.searchsorted(keys, code[left]), max(len(keys) - 1, 0))
            hit = keys[place] == code[left] if len(keys) else np.zeros(len(left), bool)
            out[left[hit]] += self.costs[depth][place[hit]]
            left = left[~hit]
            out[left] += self._escape(depth, code[left])
            depth -= 1
            code = code & np.uint64((1 << (8 * (depth + 1))) - 1)
        out[left] += 8.0
        return out


class Coder:
    """A worker's view of the trees: a direct-mapped table of computed grams."""

    def __init__(self, trees: ContextTrees, table_bytes: int = TABLE_BYTES):
        self.trees = trees
        self.log = max(8, int(np.log2(table_bytes / (8 + 8 * max(1, len(trees.langs))))))
        self.keys = np.full(1 << self.log, np.iinfo(np.uint64).max)
        self.values = np.zeros((1 << self.log, len(trees.langs)))

    def _step(self, code: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            slot = ((code * _MIX) >> np.uint64(64 - self.log)).astype(np.int64)
        new = np.flatnonzero(self.keys[slot] != code)
        out = self.values[slot]
        if len(new):
            kinds, back = np.unique(code[new], return_inverse=True)
            made = self.trees.lengths(kinds)
            out[new] = made[back]
            with np.errstate(over="ignore"):
                slot = ((kinds * _MIX) >> np.uint64(64 - self.log)).astype(np.int64)
            # Of grams with one slot the last one stays, in both arrays.
            slot, last = np.unique(slot[::-1], return_index=True)
            self.keys[slot], self.values[slot] = kinds[::-1][last], made[::-1][last]
        return out

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each whole text in each language; no text is empty."""
        data, at, first = laid_out(texts, self.trees.order)
        out = np.zeros((len(texts), len(self.trees.langs)))
        for a in range(0, len(at), STEP):
            part = at[a : a + STEP]
            cost = self._step(grams(data, part, self.trees.order))
            i, j = np.searchsorted(first, a, "right") - 1, np.searchsorted(first, a + len(part))
            out[i:j] += np.add.reduceat(cost, np.maximum(first[i:j] - a, 0), axis=0)
        return out


def learn(labelled: DataFrame, sample: int = SAMPLE, order: int = ORDER, languages: int = LANGUAGES, key: str = "doc_id", text: str = "text", lang: str = "lang") -> ContextTrees:
    """Learn from at most `sample` texts of each of the `languages` most frequent ones."""
    rows = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"), F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(23)), F.lit(1 << 40)).alias("draw")).where("lang IS NOT NULL AND text <> ''")
    per = rows.groupBy("lang").agg(F.count("*").alias("rows"), F.approx_count_distinct("draw").alias("n")).orderBy(F.col("rows").desc(), "lang").limit(languages).collect()
    if not per:
        return ContextTrees({}, order)
    # Draws are even, so this bound leaves well over `sample` ids; the window takes the smallest.
    bound = F.create_map(*[F.lit(x) for r in per for x in (r["lang"], int(min(1.0, 1.5 * sample / r["n"]) * (1 << 40)) + 1)])
    near = rows.where(F.col("draw") < F.try_element_at(bound, F.col("lang"))).groupBy("lang", "draw").agg(F.min("text").alias("text"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    chosen = near.withColumn("nth", first).where(F.col("nth") <= sample).select("lang", "text").collect()
    samples: dict[str, list[bytes]] = {}
    for r in sorted(chosen):
        samples.setdefault(r["lang"], []).append(coded(r["text"]))
    return ContextTrees(samples, order)


def predict(docs: DataFrame, trees: ContextTrees, text: str = "text", out: tuple[str, str, str] = ("lang_pred", "score", "bits_a_byte")) -> DataFrame:
    """docs with the language, its posterior probability under equal priors and
    the bits a byte of its code, as three columns."""
    cast = docs.sparkSession.sparkContext.broadcast(trees)  # bounded by the learning sample
    kind = F.pandas_udf(_predictor(cast), "lang string, score double, bits double")
    held = "__language"
    made = bounded_batches(docs).withColumn(held, kind(F.col(text).cast("string")))
    return made.withColumns({n: F.col(f"{held}.{f}") for n, f in zip(out, ("lang", "score", "bits"))}).drop(held)


def _predictor(cast):
    import pandas as pd

    def told(texts: list[bytes], coder: Coder) -> list[tuple]:
        bits = coder.bits(texts)
        best = bits.argmin(1)
        least = bits[np.arange(len(texts)), best]
        score = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
        return [(coder.trees.langs[b], float(s), float(n / len(t))) for b, s, n, t in zip(best.tolist(), score, least, texts)]

    def predictor(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = Coder(cast.value)
        for texts in batches:
            rows, held, size = [(UND, 0.0, 0.0)] * len(texts), {}, 0
            for i, t in enumerate(texts):
                if coder.trees.langs and has_letter(t):
                    held[i] = coded(t)
                    size += len(held[i])
                if held and (size > STEP or i == len(texts) - 1):
                    for k, row in zip(held, told(list(held.values()), coder)):
                        rows[k] = row
                    held, size = {}, 0
            yield pd.DataFrame(rows, columns=["lang", "score", "bits"])
        del coder
        trimmed()

    predictor.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return predictor


def query(spark, sf_dir):
    from .common import table

    docs = table(spark, sf_dir, "documents").withColumn("held_out", remainder(F.col("doc_id"), 4) == 2)
    trees = learn(docs.where(~F.col("held_out")))
    return predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text"), trees).select("doc_id", "held_out", "lang_pred", "score", "bits_a_byte")
