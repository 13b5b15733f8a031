"""File ledgers of two snapshots, and the versions and blobs behind them.

Matching goes from cheap to dear: paths first, then content that is unique on
both sides, and only what is left is scored. Everything is an equi-join on a
path or a hash; contents are compared by SHA-256 and length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bags


def snapshot(files: DataFrame, path: str = "path", content: str = "content", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, path, sha, length): what a ledger needs of a tree of files."""
    c = F.coalesce(F.col(content), F.lit("")).cast("binary")
    return files.select(*keys, F.col(path).alias("path"), F.sha2(c, 256).alias("sha"), F.octet_length(c).alias("length"))


def file_ledger(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = (), whole_tree: bool = False) -> DataFrame:
    """(keys, kind, before_path, after_path, before_sha, after_sha).

    Same path: modified if the content differs. Of the rest, content that one
    file has on each side is a rename; content that several files have stays
    added and deleted. whole_tree counts files of the same path too (commit
    trees); otherwise only unmatched files (folders). Uniqueness is an
    aggregation by content, not a window, so a content that very many files have
    is one row before the join.
    """
    k = list(keys)
    same = before.alias("b").join(after.alias("a"), [*k, "path"], "full_outer").select(*k, "path", F.col("b.sha").alias("before_sha"), F.col("a.sha").alias("after_sha"))
    modified = same.where("before_sha <> after_sha").select(*k, F.lit("modified").alias("kind"), F.col("path").alias("before_path"), F.col("path").alias("after_path"), "before_sha", "after_sha")
    gone = same.where("after_sha IS NULL").select(*k, F.col("path").alias("before_path"), F.col("before_sha").alias("sha"))
    new = same.where("before_sha IS NULL").select(*k, F.col("path").alias("after_path"), F.col("after_sha").alias("sha"))

    def single(left: DataFrame, tree: DataFrame) -> DataFrame:
        counted = tree.select(*k, "sha") if whole_tree else left.select(*k, "sha")
        return counted.groupBy(*k, "sha").count().where("count = 1").select(*k, "sha")

    on = [*k, "sha"]
    renamed = gone.join(single(gone, before), on, "left_semi").join(new.join(single(new, after), on, "left_semi"), on)
    renamed = renamed.select(*k, F.lit("renamed").alias("kind"), "before_path", "after_path", F.col("sha").alias("before_sha"), F.col("sha").alias("after_sha"))
    none = F.lit(None).cast("string")
    deleted = gone.join(renamed.select(*k, "before_path"), [*k, "before_path"], "left_anti").select(*k, F.lit("deleted").alias("kind"), "before_path", none.alias("after_path"), F.col("sha").alias("before_sha"), none.alias("after_sha"))
    added = new.join(renamed.select(*k, "after_path"), [*k, "after_path"], "left_anti").select(*k, F.lit("added").alias("kind"), none.alias("before_path"), "after_path", none.alias("before_sha"), F.col("sha").alias("after_sha"))
    return modified.unionByName(renamed).unionByName(deleted).unionByName(added)


def token_counts(files: DataFrame, text: str, keys: tuple[str, ...]) -> DataFrame:
    """(keys, token, n) of code tokens."""
    from ..functions.text import code_tokens

    return files.select(*keys, F.explode(code_tokens(F.col(text))).alias("token")).groupBy(*keys, "token").agg(F.count("*").alias("n"))


def dice_pairs(left: DataFrame, right: DataFrame, on: tuple[str, ...], a: str, b: str, text: str = "body", least: int = 880, tokens: int = 12, distinct: int = 8) -> DataFrame:
    """(on, a, b, permille): multiset Dice of code tokens of pairs that agree in
    `on`, from `least` permille on.

    With least > 0 pairs are found by the rarest tokens of their bags, and no bag is moved
    but those of likely pairs (bags.like_pairs); with least <= 0 all pairs that share a token are joined."""
    if least > 0:
        from ..functions.text import code_tokens

        return bags.like_pairs(left, right, on, a, b, text, code_tokens, least, tokens, distinct)
    x, y = token_counts(left, text, (*on, a)), token_counts(right, text, (*on, b))
    size = lambda t, key, name: t.groupBy(*on, key).agg(F.sum("n").alias(name), F.count("*").alias(f"{name}_kinds"))
    sx, sy = size(x, a, "sx"), size(y, b, "sy")
    shared = F.sum(F.least("nx", "ny")).alias("shared")
    met = x.withColumnRenamed("n", "nx").join(y.withColumnRenamed("n", "ny"), [*on, "token"])
    scored = met.groupBy(*on, a, b).agg(shared).join(sx, [*on, a]).join(sy, [*on, b])
    permille = F.floor(2000 * F.col("shared") / (F.col("sx") + F.col("sy"))).cast("int")
    fit = (F.col("sx") >= tokens) & (F.col("sy") >= tokens) & (F.col("sx_kinds") >= distinct)
    return scored.where(fit).select(*on, a, b, permille.alias("permille")).where(F.col("permille") >= least)


def rename_candidates(ledger: DataFrame, before: DataFrame, after: DataFrame, keys: tuple[str, ...] = (), least: int = 750) -> DataFrame:
    """Edited renames among the ledger's added and deleted files: mutual best
    pairs by token Dice of files that share an extension."""
    from ..functions.text import extension

    k = tuple(keys)
    gone = ledger.where("kind = 'deleted'").select(*k, F.col("before_path").alias("path")).join(before, [*k, "path"]).withColumn("ext", extension(F.col("path"))).withColumnRenamed("path", "before_path")
    new = ledger.where("kind = 'added'").select(*k, F.col("after_path").alias("path")).join(after, [*k, "path"]).withColumn("ext", extension(F.col("path"))).withColumnRenamed("path", "after_path")
    pairs = dice_pairs(gone, new, (*k, "ext"), "before_path", "after_path", "content", least, 1, 1)
    best = lambda own, other: F.row_number().over(Window.partitionBy(*k, own).orderBy(F.col("permille").desc(), other))
    return pairs.withColumn("r1", best("before_path", "after_path")).withColumn("r2", best("after_path", "before_path")).where("r1 = 1 AND r2 = 1").drop("r1", "r2", "ext")


def changes_by_kind(ledger: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return ledger.groupBy(*keys, "kind").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- versions and blobs


def missing_blobs(files: DataFrame, blobs: DataFrame) -> DataFrame:
    """Blobs to append: contents by hash, one each, that the store lacks."""
    content = F.coalesce(F.col("content"), F.lit("")).cast("binary")
    # Known contents go before any content moves; of the others one a task does.
    new = files.select(F.sha2(content, 256).alias("sha"), content.alias("content"))
    lacking = new.select("sha").distinct().join(blobs.select("sha"), "sha", "left_anti")
    return new.join(lacking, "sha", "left_semi").groupBy("sha").agg(F.first("content").alias("content"))


def resolve_versions(versions: DataFrame, blobs: DataFrame) -> DataFrame:
    """versions with their content, hashed again, and state ok, missing or corrupt."""
    joined = versions.join(blobs, "sha", "left")
    state = F.when(F.col("content").isNull(), "missing").when(F.sha2("content", 256) != F.col("sha"), "corrupt").otherwise("ok")
    return joined.withColumn("state", state)


def import_report(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """(added, duplicate, unsupported, missing): candidates (path, sha?) against
    known (path, sha); a second row of the same path and content is a duplicate."""
    from ..functions.text import supported_file

    # Rows of a path and content are counted before the join, so that none of them is hot.
    counted = candidates.groupBy("path", "sha").agg(F.count("*").alias("n"))
    seen = counted.join(known.select("path", "sha").distinct().withColumn("known", F.lit(True)), ["path", "sha"], "left")
    bad, none, old = ~supported_file(F.col("path")), F.col("sha").isNull(), F.coalesce("known", F.lit(False))
    n = F.col("n")
    parts = {
        "added": F.when(~bad & ~none & ~old, 1),
        "duplicate": F.when(~bad & ~none, F.when(old, n).otherwise(n - 1)),
        "unsupported": F.when(bad, n),
        "missing": F.when(~bad & none, n),
    }
    return seen.agg(*[F.coalesce(F.sum(v), F.lit(0)).cast("long").alias(k) for k, v in parts.items()])


def source_state(files: DataFrame) -> DataFrame:
    """(path, length, modified, sha) of a binaryFile table."""
    return files.select("path", F.octet_length("content").alias("length"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha"))


def changed_inputs(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths whose state is another one, or gone; empty if inputs stood still."""
    return before.join(after, ["path", "length", "modified", "sha"], "left_anti").select("path")


def event_id(*fields: Column) -> Column:
    """The identity of a change: SHA-256 of its fields as JSON."""
    return F.sha2(F.to_json(F.struct(*fields)), 256)
