"""Arriving versions as a stream (an extension: the batch API is complete without it)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.diff import line_hunks


def distinct_versions(versions: DataFrame, time: str = "added_at", late: str = "10 minutes") -> DataFrame:
    """Versions without repeated imports of the same path and content within the
    watermark, whose state is dropped as it passes."""
    return versions.withWatermark(time, late).dropDuplicatesWithinWatermark(["path", "sha"])


def hunks_between_versions(versions: DataFrame) -> DataFrame:
    """(path, version, ord, kind, before_start, …): each arriving version
    (path, version, content) against the one before; the state holds one text a path."""

    def step(key, batches, state):
        last = state.get[0] if state.exists else None
        rows = []
        for g in batches:
            for version, content in g.sort_values("version")[["version", "content"]].itertuples(index=False):
                content = content or ""
                if last is not None:
                    rows += [(*key, version, n, *h) for n, h in enumerate(line_hunks(last, content), 1)]
                last = content
        state.update((last,))
        yield pd.DataFrame(rows, columns=["path", "version", "ord", "kind", "before_start", "before_end", "after_start", "after_end"])

    schema = "path string, version long, ord int, kind string, before_start int, before_end int, after_start int, after_end int"
    return versions.select("path", F.col("version").cast("long").alias("version"), "content").groupBy("path").applyInPandasWithState(step, schema, "last string", "append", "NoTimeout")
