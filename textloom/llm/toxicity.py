"""Toxicity by a weighted finite-state pattern grammar.

Five small transducers read the words of a clause at the same time: insult,
threat, target, negation and reported speech. Their composition is one
deterministic machine whose state is the tuple of their states; at the clause's
end the state says which pattern matched (an insult with a target, a negated
insult, a quoted threat, ...), and that pattern's weight counts: the same word
weighs less when its clause negates or quotes it, and more when the clause has a
target. A word without a target, negation or report is a pattern of its own; the
grammar's weight for it, however often it comes, stays below THRESHOLD, so it
counts as toxic only as far as labelled texts show that it is.

The insult transducer knows a lexicon of our own and the stems that labelled
texts teach it: word beginnings (and whole words) that stand in many different
contexts of texts labelled 1 and in hardly any of texts labelled 0. Contexts and
not texts are counted, so that copies of one text teach nothing by their number.
They are learned from at most SAMPLE texts labelled 1 and 3 * SAMPLE labelled 0,
whole, those with the smallest hash of their id.

A text's features are how many clauses matched each pattern (0, 1, 2, 3 or
more) and its length class; its score is the logistic function of their weighted sum. The weights
start from the grammar's own and are refitted on labelled texts by ridge
regression around them, so a pattern that the labels never show keeps the
grammar's weight. The fit uses every labelled text: they are aggregated in Spark
to counts of feature vectors, of which there are at most 6 * 4 ** len(PATTERNS).

Defined cases: null and empty texts match nothing and get the score of the empty
feature vector; labels that are null or not 0 or 1 are not learned from, of
several labels of one id the largest counts; without labels the grammar's
weights hold; repeated rows are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder, saved, trimmed

# The lexicon of the grammar, our own choice, in the order English, French, German, Spanish.
INSULT = """
idiot moron stupid worthless pathetic disgusting loser scum trash clown dumb imbecile fool jerk
garbage vermin filth bastard coward creep freak dimwit halfwit lowlife parasite retarded ugly
imbécile crétin débile connard abruti ordure minable
dumm dummkopf trottel abschaum versager widerlich
estúpido imbécil basura patético asqueroso inútil escoria
""".split()
THREAT = """
kill murder hurt stab shoot strangle destroy beat burn hang slaughter
tuer frapper égorger töten umbringen erschlagen matar golpear degollar
""".split()
TARGET = """
you your yours u he she they them him her his their these those people everyone
tu toi vous ton ta ils elles du dich dir euch ihr sie tú te ti usted ustedes ellos
""".split()
NEGATION = "not no never isn't aren't wasn't don't doesn't neither nor without ne pas jamais nicht kein keine nie nunca jamás sin".split()
REPORT = "said says wrote writes called calls claimed quoted reported alleged accused dit écrit sagte schrieb dijo escribió".split()

PATTERNS = ("insult_direct", "insult_bare", "insult_negated", "insult_reported", "threat_direct", "threat_bare", "threat_softened")
#: The grammar's own weights: of no match, of each pattern, and of the length
#: class of a text with a match (one match says less about a long text).
PRIOR = (-4.0, 4.5, 1.9, 1.0, 1.5, 4.5, 0.5, 0.5, -0.2)
MOST = 3
THRESHOLD = 0.3
#: Texts labelled 1 that stems are learned from.
SAMPLE = 1000
STEMS = (4, 5, 6, 7, 8)
#: A stem is kept if chance gives one like it with this probability, over all
#: candidates, and is this many times as frequent in texts labelled 1.
CHANCE, TIMES = 1e-3, 30
#: A stem goes on to a letter that this share of its contexts has.
AGREE = 0.97
#: Words that a negation reaches.
REACH = 3

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_STOP = re.compile(r"[.!?;\n\r…]")
_CLASS = {w: c for words, c in ((TARGET, "t"), (NEGATION, "n"), (REPORT, "r"), (THREAT, "k"), (INSULT, "i")) for w in words}
_CLASS |= {w + s: c for w, c in list(_CLASS.items()) if c in "ki" for s in ("s", "es")}


def _negation(state, cls):
    return REACH if cls == "n" else max(0, state - 1)


def _report(state, cls):
    return state or cls == "r"


def _target(state, cls):
    return state or cls == "t"


def _head(kind):
    """States: 0 none, 1 negated, 2 reported, 3 plain; the strongest of a clause stays."""

    def step(state, cls, negated, reported):
        return state if cls != kind else max(state, 1 if negated else 2 if reported else 3)

    return step


_insult, _threat = _head("i"), _head("k")


class Grammar:
    """The composed machine, its arcs built as they are first taken.

    stems: learned insults; one that ends in * is the beginning of words."""

    def __init__(self, stems: tuple[str, ...] = ()):
        self.arcs: dict[tuple, tuple] = {}
        own = "|".join(sorted(INSULT + THREAT, key=len, reverse=True))
        learned = "|".join(re.escape(s[:-1]) + r"\w*" if s.endswith("*") else re.escape(s) for s in stems)
        self.head = re.compile(rf"(?<!\w)(?:(?:{own})(?:s|es)?{'|' * bool(learned)}{learned})(?!\w)")
        self.stem = re.compile(learned) if learned else None

    def _class(self, word: str) -> str:
        found = _CLASS.get(word, "-")
        return "i" if found == "-" and self.stem and self.stem.fullmatch(word) else found

    def _arc(self, state, cls):
        insult, threat, target, negated, reported = state
        return (_insult(insult, cls, negated, reported), _threat(threat, cls, negated, reported), _target(target, cls), _negation(negated, cls), _report(reported, cls))

    def clause(self, words: list[str]) -> tuple[int, ...]:
        """Numbers of the patterns that a clause matches."""
        state = (0, 0, False, 0, False)
        for w in words:
            key = (state, self._class(w))
            new = self.arcs.get(key)
            if new is None:
                new = self.arcs[key] = self._arc(*key)
            state = new
        insult, threat, target = state[:3]
        out = []
        if insult:
            out.append((None, 2, 3, 0 if target else 1)[insult])
        if threat:
            out.append((None, 6, 6, 4 if target else 5)[threat])
        return tuple(out)

    def features(self, text: str | None) -> list[int]:
        """Clauses that match each pattern, MOST at most, and the length class
        (0 to 5, in powers of 4 from 256 characters on; 0 without a match)."""
        n = [0] * (len(PATTERNS) + 1)
        if not text:
            return n
        low, done = text.lower(), 0
        for head in self.head.finditer(low):
            if head.start() < done:
                continue
            start = done
            for stop in _STOP.finditer(low, done, head.start()):
                start = stop.end()
            stop = _STOP.search(low, head.end())
            done = stop.end() if stop else len(low)
            for k in self.clause(_WORD.findall(low, start, done)):
                n[k] += 1
        if any(n):
            n[-1] = min(5, max(0, (len(text) // 128).bit_length() // 2))
        return [min(x, MOST) for x in n[:-1]] + n[-1:]


def choose(good: dict[str, int]) -> tuple[str, ...]:
    """Of significant stems and their contexts, those that stand for all."""
    longer: dict[str, list[str]] = {}
    for s in good:
        if s.endswith("*") and len(s) - 1 > STEMS[0]:
            longer.setdefault(s[:-2] + "*", []).append(s)
    out: set[str] = set()
    for s in good:
        if len(s) - 1 == STEMS[0] and s.endswith("*"):
            # As long as nearly all contexts agree on the next letter, the stem has it.
            while (more := max(longer.get(s, []), key=lambda x: (good[x], x), default=None)) and good[more] >= AGREE * good[s]:
                s = more
            out.add(s)
        elif not s.endswith("*") and len(s) < STEMS[0]:
            out.add(s)
    # Where a short stem is too common elsewhere, the longer ones and whole words stand for themselves.
    for s in sorted(good, key=lambda x: (len(x.rstrip("*")), x)):
        if not any(s.rstrip("*").startswith(o.rstrip("*")) or o.startswith(s.rstrip("*")) for o in out):
            out.add(s)
    return tuple(sorted(out))


def learn_stems(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text") -> tuple[str, ...]:
    """Stems from at most `sample` texts labelled 1 and three times as many
    labelled 0. Contexts are counted in Spark; only significant stems, whose
    number the sample bounds, come to the driver."""
    marks = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").alias("toxic"))
    draw = F.xxhash64("id", F.lit(29))
    chosen = [marks.where(F.col("toxic") == t).orderBy(draw, "id").limit(n) for t, n in ((1, sample), (0, 3 * sample))]
    picked = F.broadcast(chosen[0].unionByName(chosen[1]))  # 4 * sample rows at most
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("t")).join(picked, "id")
    words = rows.select("toxic", F.regexp_extract_all(F.lower("t"), F.lit(r"\p{L}+(?:['’]\p{L}+)?"), F.lit(0)).alias("w"))
    beside = words.select("toxic", F.explode(F.arrays_zip("w", F.concat(F.array(F.lit("")), "w").alias("before"), F.slice("w", 2, 1 << 30).alias("after"))).alias("z"))
    met = beside.select("toxic", F.col("z.w").alias("w"), F.xxhash64("z.before", "z.after").alias("context")).where(F.col("w").isNotNull() & ~F.col("w").isin(*_CLASS))
    side = lambda t: F.count_if(F.col("toxic") == t)
    whole = saved(met.distinct().groupBy("w").agg(side(1).alias("n1"), side(0).alias("n0")), "words")
    size = whole.agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).first()
    n1, n0 = size["n1"] or 0, size["n0"] or 0
    if not n1:
        return ()
    starts = [F.when(F.length("w") >= k, F.concat(F.substring("w", 1, k), F.lit("*"))) for k in STEMS]
    stems = whole.select(F.explode(F.array_compact(F.array("w", *starts))).alias("stem"), "n1", "n0").groupBy("stem").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).where("n1 > 0")
    stems = saved(stems, "stems")
    least = max(3.0, float(np.log(CHANCE / max(2, stems.count())) / np.log(min(n1 / (n1 + n0), 0.99))))
    frequent = F.col("n1") / n1 >= TIMES * (F.col("n0") + 0.1) / max(1, n0)
    return choose({r["stem"]: r["n1"] for r in stems.where((F.col("n1") >= least) & frequent).collect()})


def match_counts(stems: tuple[str, ...] = ()):
    """A column function: array<int> of the clauses that match each pattern."""

    @F.pandas_udf("array<int>")
    def matched(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        grammar = Grammar(stems)
        for texts in batches:
            yield pd.Series([grammar.features(t) for t in texts], dtype=object)
        trimmed()

    return matched


def _strength(n: int) -> float:
    """What n clauses of a pattern weigh: the first one most."""
    return 1 + 0.5 * float(np.log(n)) if n else 0.0


def fit(rows: list[tuple[list[int], int, int]], ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights from (features, label, number of texts); Newton steps of a
    logistic regression whose penalty pulls to PRIOR."""
    prior = np.array(PRIOR)
    if not rows:
        return prior
    x = np.array([[1.0, *map(_strength, f[:-1]), float(f[-1])] for f, _, _ in rows])
    y, n = np.array([float(r[1]) for r in rows]), np.array([float(r[2]) for r in rows])
    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - y)) + ridge * (w - prior)
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(matched: DataFrame, labels: DataFrame) -> np.ndarray:
    """matched: (doc_id, f); labels: (doc_id, toxic)."""
    marks = labels.where(F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    rows = matched.select("doc_id", "f").join(marks, "doc_id").groupBy("f", "toxic").agg(F.count("*").alias("n")).collect()
    return fit([(list(r["f"]), r["toxic"], r["n"]) for r in sorted(rows, key=lambda r: (list(r["f"]), r["toxic"]))])


def score(f, weights):
    """A column: the score of a feature column."""
    total = F.lit(float(weights[0]))
    total = total + F.lit(float(weights[-1])) * F.get(f, F.lit(len(PATTERNS)))
    for k, w in enumerate(weights[1:-1]):
        n = F.get(f, F.lit(k))
        total = total + F.when(n > 0, F.lit(float(w)) * (1 + 0.5 * F.log(n.cast("double")))).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def query(spark, sf_dir):
    from .common import table

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learned = labels.where(remainder(F.col("doc_id"), 4) != 2)
    stems = learn_stems(docs, learned)
    matched = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), match_counts(stems)(F.col("text").cast("string")).alias("f")), "toxic")
    weights = learn(matched, learned)
    out = matched.withColumn("held_out", remainder(F.col("doc_id"), 4) == 2).withColumn("score", score(F.col("f"), weights))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
