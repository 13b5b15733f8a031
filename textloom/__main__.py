"""Changes of two files or folders as text: python -m textloom BEFORE AFTER."""

from __future__ import annotations

import sys
from pathlib import Path


def file_lines(before: str, after: str) -> list[str]:
    """One line a hunk, with the lines that it takes out and puts in."""
    from .operators.diff import line_hunks

    x, y = (t.splitlines(keepends=True) for t in (before, after))
    out = []
    for kind, p, q, r, s in line_hunks(before, after):
        out.append(f"{kind} {p + 1},{q} {r + 1},{s}")
        out += [f"- {t.rstrip()}" for t in x[p:q]] + [f"+ {t.rstrip()}" for t in y[r:s]]
    return out


def main(args: list[str]) -> int:
    if len(args) != 2:
        print(__doc__)
        return 2
    before, after = map(Path, args)
    if before.is_dir() and after.is_dir():
        from pyspark.sql import SparkSession

        from .operators.ledger import file_ledger, snapshot
        from .sources.decode import read_snapshot

        spark = SparkSession.builder.getOrCreate()
        rows = file_ledger(*[snapshot(read_snapshot(spark, str(p))) for p in (before, after)]).orderBy("kind", "before_path", "after_path")
        for r in rows.toLocalIterator():
            print(r.kind, r.before_path or "", *([r.after_path] if r.kind == "renamed" else [r.after_path] if r.before_path is None else []))
    else:
        print("\n".join(file_lines(*[p.read_bytes().decode("utf-8", "surrogateescape") for p in (before, after)])))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
