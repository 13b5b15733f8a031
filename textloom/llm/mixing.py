"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a word target; every document of the source starts with the
same fractional number of copies, target / source size. The integral part is
taken at once. What is left is a copy probability, and the pivotal method
(Deville and Tille, 1998) rounds the probabilities jointly: two fractional
documents meet, mass measured in words moves from one to the other in a random
direction until one of them is integral, and the other meets the next. The
number of words is preserved by each meeting, and each document's expected
copies are its start value.

The meetings form a reduction tree. The leaves are (source, bucket) groups of
about LEAF documents, so a source with a third of all rows is many leaves;
each leaf hands up at most one fractional document, and FAN leaves make a node
of the next level, until one is left for each source. The last one is rounded
by its own random number, so a source misses its target by less than the words
of one document.

Repeated rows (same doc_id, source and size) are one item with a count n: of the
n * p copies that they are owed beyond the integral part, the whole ones go to
the first rows, and only what is left, less than one row's words, takes part in
the meetings. So a row that is there very often moves no target by more than one
document either. They are counted before any shuffle of rows, and dealt out again
in runs of RUN rows by many tasks.

Defined cases: null text has size 0; a null source is a source of its own,
ranked last; a null doc_id is an id like any other; items of size 0 are rounded
alone; an empty table gives an empty result. The table of sources (one row a
source) is ranked and levelled by one task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, saved

LEAF, FAN, EPS = 4096, 64, 1e-9
#: Repeated rows that one task gives out at a time.
RUN = 10_000
WEIGHTS = (3, 1, 2)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, n_items, target): one row for each source.

    Sources by code point, null last, take the weights in turn and share
    `share` of all words; targets stop at `most` times the source's size and
    the excess goes to the others by weight. That fixed point is a level L
    with target = least(weight * L, cap), found by one ordered pass over the
    source table, whose length is the number of sources.
    """
    w = Window.orderBy(F.col("source").asc_nulls_last())
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n_rows")).alias("source_size"), F.count("*").alias("n_items"))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(w) - 1) % len(weights) + 1).cast("int")).cast("double"))
    per = per.withColumn("cap", most * F.col("source_size")).withColumn("full_at", F.col("cap") / F.col("weight"))
    o = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("cap").over(o.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_w = F.sum("weight").over(o.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    per = per.withColumn("level", (share * F.sum("source_size").over(whole) - before) / open_w)
    per = per.withColumn("level", F.coalesce(F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(whole)["level"], F.lit(float("inf"))))
    return per.select("source", "source_size", "n_items", F.least(F.col("weight") * F.col("level"), F.col("cap")).alias("target"))


def _meet(g: pd.DataFrame) -> pd.DataFrame:
    """Round one node of the tree; at most one row stays fractional."""
    g = g.sort_values(["mass", "u", "size"], ascending=[False, True, True], kind="stable")
    p, mass, u = g["p"].tolist(), g["mass"].tolist(), g["u"].tolist()
    j = -1
    for i in range(len(p)):
        if not EPS < p[i] < 1 - EPS:
            p[i] = float(round(p[i]))
            continue
        if mass[i] == 0:
            p[i] = float(u[i] < p[i])
            continue
        if j < 0:
            j = i
            continue
        up = min((1 - p[i]) * mass[i], p[j] * mass[j])
        down = min(p[i] * mass[i], (1 - p[j]) * mass[j])
        d = up if u[i] * (up + down) < down else -down
        p[i] += d / mass[i]
        p[j] -= d / mass[j]
        left = [k for k in (j, i) if EPS < p[k] < 1 - EPS]
        for k in (i, j):
            if k not in left:
                p[k] = float(round(p[k]))
        j = left[0] if left else -1
    return g.assign(p=p)


def rounded(items: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 17, key: tuple[str, ...] = ("doc_id", "source", "size")) -> DataFrame:
    """items: (key, source, size, n_rows) -> (key, n_rows, source_size, target,
    sure, whole, extra): every row of an item is taken `sure` times, its first
    `whole` rows once more, and the next one `extra` (0 or 1) times more."""
    k = list(key)
    targets = source_targets(items, weights, share, most)
    start = items.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    start = start.withColumn("rate", rate).withColumn("sure", F.floor(F.col("rate") + EPS)).withColumn("owed", F.col("n_rows") * F.greatest(F.lit(0.0), F.col("rate") - F.col("sure")))
    start = start.withColumn("whole", F.floor(F.col("owed") + EPS)).withColumn("p", F.greatest(F.lit(0.0), F.col("owed") - F.col("whole")))
    leaves = F.ceil(F.col("n_items") / LEAF)
    node = F.pmod(F.xxhash64(*k, F.lit(seed)), leaves)
    draw = lambda level: F.pmod(F.xxhash64(*k, F.lit(seed + level)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    start = start.select(*k, "n_rows", "source_size", "target", "sure", "whole", "p", F.col("size").cast("double").alias("mass"), node.alias("node"), leaves.alias("nodes"), draw(1).alias("u"))
    level, done = 1, None
    while True:
        out = saved(start.groupBy("source", "node").applyInPandas(_meet, start.schema), "mix")
        ended = out.where(~((F.col("p") > EPS) & (F.col("p") < 1 - EPS)))
        done = ended if done is None else done.unionByName(ended)
        left = out.where((F.col("p") > EPS) & (F.col("p") < 1 - EPS))
        if (left.agg(F.max("nodes")).first()[0] or 0) <= 1:
            break
        level += 1
        start = left.withColumn("node", F.floor(F.col("node") / FAN)).withColumn("nodes", F.ceil(F.col("nodes") / FAN)).withColumn("u", draw(level))
    done = done.unionByName(left.withColumn("p", (draw(level + 1) < F.col("p")).cast("double")))
    return done.select(*k, "n_rows", "source_size", "target", "sure", "whole", F.round("p").cast("long").alias("extra"))


def _numbered(df: DataFrame, n: str, name: str) -> DataFrame:
    """Each row n times, numbered from 1. Rows with a large n go to many tasks."""
    runs = df.withColumn("__run", F.explode(F.sequence(F.lit(0), F.ceil(F.col(n) / RUN).cast("long") - 1)))
    few, many = runs.where(F.col(n) <= RUN), runs.where(F.col(n) > RUN)
    dealt = few.unionByName(many.repartition("__run"))
    first = F.col("__run") * RUN
    return dealt.withColumn(name, F.explode(F.sequence(first + 1, F.least(first + RUN, F.col(n))))).drop("__run")


def mix(items: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """items: (doc_id, source, size) rows -> the same rows with source_size,
    target, copies (0..most) and taken = copies * size."""
    counted = saved(items.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n_rows")), "mix")
    rows = _numbered(rounded(counted, weights, share, most, seed), "n_rows", "occurrence")
    at = F.col("occurrence")
    copies = (F.col("sure") + F.when(at <= F.col("whole"), 1).when(at == F.col("whole") + 1, F.col("extra")).otherwise(0)).cast("long")
    return rows.withColumn("copies", copies).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source", "occurrence")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size) of documents; size is the number of words."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def mix_documents(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """The mixture itself: each row of docs as often as it is taken, with the
    columns of docs. Rows that are equal in all columns are one item; their
    copies come from one of them."""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    plain = [F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in t else F.col(f"`{c}`") for c, t in docs.dtypes]
    rid = F.concat(F.xxhash64(*plain), F.lit("/"), F.xxhash64(F.lit(seed), *plain))
    items = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), rid.alias("rid"))
    counted = saved(items.groupBy("doc_id", "source", "size", "rid").agg(F.count("*").alias("n_rows")), "mix")
    total = F.col("n_rows") * F.col("sure") + F.col("whole") + F.col("extra")
    taken = saved(rounded(counted, weights, share, most, seed, ("doc_id", "source", "size", "rid")).select("rid", "n_rows", total.alias("total")).where("total > 0"), "mix")
    keyed = docs.select(F.struct("*").alias("row"), rid.alias("rid"))
    # Rows that are there once, which nearly all are, move once; of the others one is kept before they move.
    single = keyed.join(taken.where("n_rows = 1"), "rid").select("row", "total")
    several = keyed.join(F.broadcast(taken.where("n_rows > 1").select("rid")) if taken.where("n_rows > 1").count() <= RUN else taken.where("n_rows > 1").select("rid"), "rid", "left_semi")
    several = several.groupBy("rid").agg(F.first("row").alias("row")).join(taken, "rid").select("row", "total")
    return _numbered(single.unionByName(several), "total", "copy").select("row.*")


def query(spark, sf_dir):
    from .common import table

    return mix(sized(table(spark, sf_dir, "documents"))).drop("occurrence")
