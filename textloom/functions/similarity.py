"""Similarity scores of two texts, token lists or sets, from 0 to 1.

The weights, floors and costs of the compound scores are fixed values: results
must agree with those of other implementations that use them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import matched_share
from .text import LEXERS, hangul_prefix, utf16_len
from .vectorized import vectorized


def _units(text: str) -> list[int]:
    raw = text.encode("utf-16-le", "surrogatepass")
    return memoryview(raw).cast("H").tolist()


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, bit-parallel (Hyyrö, 2004) on
    whole numbers as wide as a is long."""
    if len(a) > len(b):
        a, b = b, a
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """2 * LCS / (len a + len b), in UTF-16 units."""
    x, y = _units(a), _units(b)
    return 2 * lcs_length(x, y) / (len(x) + len(y)) if x or y else 1.0


def sequence_ratio(a: str, b: str) -> float:
    """Share of longest matching blocks, found again on both sides of each."""
    plain = len(a) == utf16_len(a) and len(b) == utf16_len(b)
    return matched_share(a, b) if plain else matched_share(_units(a), _units(b))


def similarity_words(text: str) -> list[str]:
    """The words that token_similarity() compares."""
    return LEXERS["similarity"].findall(text.lower())


def token_similarity(a: str, b: str, cells: int = 4_000_000) -> float:
    """2 * LCS / (n + m) over words; matching blocks instead beyond `cells`."""
    return words_similarity(similarity_words(a), similarity_words(b), cells)


def words_similarity(x: list[str], y: list[str], cells: int = 4_000_000) -> float:
    """token_similarity() of texts that are cut into words already."""
    if not x and not y:
        return 1.0
    if len(x) * len(y) > cells:
        return matched_share(x, y)
    return 2 * lcs_length(x, y) / (len(x) + len(y))


def hangul_word_cost(a: str, b: str) -> float:
    """0 for equal words, a small cost for a shared beginning, else 1.45."""
    if a == b:
        return 0.0
    p = hangul_prefix(a, b)
    return 0.24 + 0.03 * abs(utf16_len(a) - utf16_len(b)) if p else 1.45


indel_ratio_col = vectorized(indel_ratio, "double")
sequence_ratio_col = vectorized(sequence_ratio, "double")
token_similarity_col = vectorized(token_similarity, "double")
hangul_word_cost_col = vectorized(hangul_word_cost, "double")


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """Shared elements over the smaller set."""
    return _share(F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b)))


def jaccard(a: Column, b: Column) -> Column:
    return _share(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def table_overlap(a: Column, b: Column) -> Column:
    """Shared distinct cell keys over the larger set."""
    return _share(F.size(F.array_intersect(a, b)), F.greatest(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))))


def share_of_sets(x: set, y: set) -> tuple[float, float]:
    """(Jaccard, containment) of two sets; 0 where a set is empty."""
    both = len(x & y)
    return (both / len(x | y) if x or y else 0.0), (both / min(len(x), len(y)) if x and y else 0.0)


def title_score(a: str, b: str, a_concepts: set, b_concepts: set) -> float:
    jac, con = share_of_sets(a_concepts, b_concepts)
    return max(indel_ratio(a, b), jac, 0.94 * con) if a and b else 0.0


def body_score(a: str, b: str, a_words: set, b_words: set) -> float:
    if a == b:
        return 1.0
    jac, con = share_of_sets(a_words, b_words)
    return max(indel_ratio(a, b), 0.88 * con, 0.82 * jac)


def structure_score(a: tuple, b: tuple) -> float:
    """1 - L1 distance over total of two structure signatures."""
    total = sum(a) + sum(b)
    return 1 - sum(abs(x - y) for x, y in zip(a, b)) / total if total else 1.0


def unit_score(title: float, body: float, structure: float, same_number: bool, titled: bool) -> float:
    """Weighted score of two document units."""
    s = 0.54 * title + 0.40 * body + 0.06 * structure if titled else 0.90 * body + 0.10 * structure
    s += 0.015 if same_number else 0.0
    s = max(s, 0.84) if titled and title >= 0.98 else max(s, 0.74) if body >= 0.98 else s
    return min(s, 1.0)


def part_score(a: str, b: str, a_words: set, b_words: set, same_label: bool) -> float:
    """Score of two list items by their keys and words."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    jac, con = share_of_sets(a_words, b_words)
    s = max(0.68 * sequence_ratio(a, b) + 0.32 * jac, 0.90 * con)
    return min(1.0, s + (0.08 if same_label else 0.0))


def paragraph_cost(similarity: float, same_container: bool = True) -> float:
    """Cost of pairing two paragraphs; leaving both alone costs two gaps of 0.48."""
    return (0.92 * (1 - similarity) if similarity >= 0.38 else 1.04) + (0.0 if same_container else 0.10)


def scored_units(pairs: DataFrame) -> DataFrame:
    """pairs (old_title, new_title, old_body, new_body, old_number, new_number)
    with title, body, structure and lineage scores as columns."""
    from .text import lineage_key_col, structure_signature, title_concepts, word_set

    side = lambda c: (F.col(f"old_{c}"), F.col(f"new_{c}"))
    keys = {f"__{n}_{c}": lineage_key_col(F.coalesce(F.col(f"{n}_{c}"), F.lit(""))) for n in ("old", "new") for c in ("title", "body")}
    k = lambda n, c: F.col(f"__{n}_{c}")
    titled = (k("old", "title") != "") & (k("new", "title") != "")
    concepts, words = [title_concepts(F.coalesce(c, F.lit(""))) for c in side("title")], [word_set(F.coalesce(c, F.lit(""))) for c in side("body")]
    title = F.when(titled, F.greatest(indel_ratio_col(k("old", "title"), k("new", "title")), jaccard(*concepts), 0.94 * containment(*concepts))).otherwise(F.lit(0.0))
    body = F.when(k("old", "body") == k("new", "body"), F.lit(1.0)).otherwise(F.greatest(indel_ratio_col(k("old", "body"), k("new", "body")), 0.88 * containment(*words), 0.82 * jaccard(*words)))
    structure = structure_similarity(*[structure_signature(F.coalesce(c, F.lit(""))) for c in side("body")])
    out = pairs.withColumns(keys).withColumns({"title": title, "body": body, "structure": structure})
    same = F.lower(F.coalesce("old_number", F.lit(""))) == F.lower(F.coalesce("new_number", F.lit("")))
    plain = F.when(titled, 0.54 * F.col("title") + 0.40 * F.col("body") + 0.06 * F.col("structure")).otherwise(0.90 * F.col("body") + 0.10 * F.col("structure")) + F.when(same, 0.015).otherwise(0.0)
    floor = F.when(titled & (F.col("title") >= 0.98), 0.84).when(F.col("body") >= 0.98, 0.74).otherwise(0.0)
    return out.withColumn("lineage", F.least(F.lit(1.0), F.greatest(plain, floor))).drop(*keys)


def structure_similarity(a: Column, b: Column) -> Column:
    """1 - L1 distance over total of two structure signatures."""
    names = ("circled", "numbers", "letters")
    diff = sum((F.abs(a[n] - b[n]) for n in names), F.lit(0))
    total = sum((a[n] + b[n] for n in names), F.lit(0))
    return F.when(total > 0, 1 - diff / total).otherwise(F.lit(1.0))
