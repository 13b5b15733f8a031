"""Commit trees and blobs by git's plumbing, called without a shell.

References are resolved on the driver, where the repository is; trees and blobs
become DataFrames, and ledgers are made by operators.ledger.
"""

from __future__ import annotations

import re
import subprocess
import threading

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_FILES, MOST_OUT, MOST_BLOB, SECONDS, MOST_STEPS = 20_000, 16 << 20, 2 << 20, 25, 64


def git(repo: str, *args: str, most: int = MOST_OUT) -> bytes:
    """Output of a git command, of `most` bytes at most: it is read as it comes, and
    the command is ended where it gives more or takes longer than SECONDS."""
    done = subprocess.Popen(["git", "-c", "core.quotepath=off", "--no-optional-locks", "-C", repo, *args], stdin=subprocess.DEVNULL, stdout=subprocess.PIPE, stderr=subprocess.PIPE)
    late = threading.Timer(SECONDS, done.kill)
    late.start()
    said: list[bytes] = []
    errors = threading.Thread(target=lambda: said.append(done.stderr.read()))
    errors.start()
    try:
        out = done.stdout.read(most + 1)
        if len(out) > most:
            raise ValueError(f"git {args[0]} gave more than {most} bytes")
        if done.wait():
            errors.join()
            raise ValueError(b"".join(said).decode("utf-8", "replace").strip() or f"git {args[0]} failed or took too long")
        return out
    finally:
        late.cancel()
        done.kill()
        errors.join()
        done.stdout.close()
        done.stderr.close()
        done.wait()


def fields(raw: bytes) -> list[str]:
    """NUL-ended fields, strict UTF-8."""
    if raw and not raw.endswith(b"\x00"):
        raise ValueError("the last field has no end")
    return [x.decode() for x in raw.split(b"\x00")[:-1]]


def resolve(repo: str, ref: str) -> str:
    if not ref or ref.startswith("-") or re.search(r"\s", ref):
        raise ValueError(f"not a reference: {ref!r}")
    return git(repo, "rev-parse", "--verify", "--end-of-options", f"{ref}^{{commit}}").decode().strip()


def tree(repo: str, commit: str) -> list[tuple[str, str]]:
    """(path, blob) of regular files."""
    out = []
    for line in fields(git(repo, "ls-tree", "-r", "-z", "--full-tree", commit)):
        meta, path = line.split("\t", 1)
        mode, kind, blob = meta.split()
        if kind == "blob" and mode in ("100644", "100755"):
            if path.startswith("/") or ".." in path.split("/"):
                raise ValueError(f"unsafe path: {path!r}")
            out.append((path, blob))
    if len(out) > MOST_FILES:
        raise ValueError(f"more than {MOST_FILES} files")
    return out


def read_tree(spark: SparkSession, repo: str, ref: str) -> DataFrame:
    """(path, sha): a commit as a snapshot for file_ledger(whole_tree=True)."""
    return spark.createDataFrame(tree(repo, resolve(repo, ref)), "path string, sha string")


def read_blobs(spark: SparkSession, repo: str, blobs: list[str]) -> DataFrame:
    """(sha, content) of blobs, read by the tasks: the repository must be a folder that
    executors see alike. A blob that is missing or larger than MOST_BLOB is an error."""

    def run(batches):
        for g in batches:
            yield pd.DataFrame({"sha": g["sha"], "content": [git(repo, "cat-file", "blob", b, most=MOST_BLOB) for b in g["sha"]]})

    names = spark.createDataFrame([(b,) for b in blobs], "sha string")
    return names.repartition(max(1, min(64, len(blobs)))).mapInPandas(run, "sha string, content binary")


def first_parents(repo: str, before: str, after: str, most: int = 16) -> list[str]:
    """Commits from before to after along first parents; before must be an ancestor."""
    a, b = resolve(repo, before), resolve(repo, after)
    path = git(repo, "rev-list", "--first-parent", "--reverse", f"{a}..{b}").decode().split()
    if git(repo, "merge-base", a, b).decode().strip() != a:
        raise ValueError("the first commit is not an ancestor of the second")
    if len(path) > min(most, MOST_STEPS):
        raise ValueError(f"more than {most} steps")
    return [a, *path]


def timeline(spark: SparkSession, repo: str, before: str, after: str, most: int = 16) -> tuple[DataFrame, DataFrame]:
    """(before, after): the trees of neighbouring commits along first parents, each
    (step, commit, path, sha), for file_ledger(keys=("step",), whole_tree=True)."""
    commits = first_parents(repo, before, after, most)
    rows = {c: tree(repo, c) for c in commits}
    side = lambda cs: spark.createDataFrame([(i, c, *f) for i, c in enumerate(cs) for f in rows[c]], "step int, commit string, path string, sha string")
    return side(commits[:-1]), side(commits[1:])


def symbol_history(spark: SparkSession, repo: str, before: str, after: str, most: int = 16, files: int = 128) -> tuple[DataFrame, DataFrame]:
    """(changes, skipped): declaration changes (step, path, …) in the files that each
    step modifies, and (step, path) of those without a supported parse."""
    from ..functions.text import extension
    from ..operators.symbols import ast_diff, parse_symbols

    old, new = timeline(spark, repo, before, after, most)
    both = old.alias("o").join(new.alias("n"), ["step", "path"]).where("o.sha <> n.sha").where(extension(F.col("path")).isin("rs", "cs"))
    changed = both.select("step", "path", F.col("o.sha").alias("old"), F.col("n.sha").alias("new")).orderBy("step", "path").limit(files + 1).collect()
    if len(changed) > files:
        raise ValueError(f"more than {files} changed files")
    keys = ("step", "path")
    names = sorted({s for r in changed for s in (r.old, r.new)})
    blobs = read_blobs(spark, repo, names) if names else spark.createDataFrame([], "sha string, content binary")
    pairs = spark.createDataFrame([tuple(r) for r in changed], "step int, path string, old string, new string")
    side = lambda c: parse_symbols(pairs.select(*keys, F.col(c).alias("sha")).join(blobs, "sha").select(*keys, F.try_validate_utf8(F.col("content").cast("string")).alias("content")), keys)
    (a, fa), (b, fb) = side("old"), side("new")
    skipped = fa.unionByName(fb).where(~F.col("supported")).select(*keys).distinct()
    return ast_diff(a.join(skipped, list(keys), "left_anti"), b.join(skipped, list(keys), "left_anti"), keys), skipped


def commit_events(spark: SparkSession, repo: str, before: str, after: str, most: int = 16, symbols: bool = True) -> DataFrame:
    """(step, kind, before_path, after_path, location, event_id): what each step along
    first parents did to files, by blob, and to declarations of the files it modified.
    Steps are numbered from the oldest; files come before their declarations."""
    from ..operators.ledger import event_id, file_ledger

    old, new = timeline(spark, repo, before, after, most)
    cols = ["step", "kind", "before_path", "after_path", "location"]
    files = file_ledger(old, new, ("step",), whole_tree=True).select("step", "kind", "before_path", "after_path", F.lit("file").alias("location"))
    if symbols:
        changes, _ = symbol_history(spark, repo, before, after, most)
        named = F.concat_ws(" -> ", "before_name", F.when(F.col("after_name") != F.coalesce("before_name", F.lit("")), F.col("after_name")))
        files = files.unionByName(changes.select("step", F.col("change").alias("kind"), F.col("path").alias("before_path"), F.col("path").alias("after_path"), F.concat(F.col("kind"), F.lit(" "), named).alias("location")))
    return files.withColumn("event_id", event_id(*map(F.col, cols)))
