"""Tables that end a lineage, in the folder that driver and executors share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def saved(df: DataFrame) -> DataFrame:
    """df written under spark.checkpoint.dir and read again.

    For tables that several later branches read: without it each branch plans
    and computes them anew. The files go when the application ends."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:  # one machine, as in tests
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="textloom-"))
        folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    path = f"{folder.rstrip('/')}/textloom-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch that goes to a Python worker.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Tell the session to end Arrow batches at BATCH_BYTES, so that the 10,000 rows of a batch
    are fewer where they are long (a smaller setting, or one with a unit, stays)."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None) or "0"
    if now.lstrip("-").isdigit() and not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def trimmed() -> None:
    """Give memory that a finished task has freed back to the system: workers are reused,
    and what one stage held would stay beside the next one's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: Rows that a sort or window holds in one task.
TASK_ROWS = 500_000


def dealt(df: DataFrame, *keys: str, each: int | None = None) -> DataFrame:
    """df dealt by keys over as many tasks as its rows need (`each` or TASK_ROWS a task, but
    spark.sql.shuffle.partitions tasks at least), for windows by those keys: their sorts
    hold what a task holds, and a fixed number of tasks would hold more as the input grows.
    The rows are counted first, so df should be a table or little more."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // (each or TASK_ROWS)))
    return df.repartition(n, *keys)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys over spark.sql.shuffle.partitions tasks. Ahead of a window
    or a grouped map by the same keys this is the shuffle that they need anyway,
    but adaptive execution does not merge its partitions by their size: aligning
    texts takes far longer than their bytes tell."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)
