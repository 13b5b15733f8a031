"""Arrow-batched scalar functions from plain Python kernels."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from ..storage import bounded_batches


def vectorized(kernel: Callable, kind: str, nulls: bool = False) -> Callable:
    """A column function that maps kernel over rows in Arrow batches.

    A null in any argument gives null, unless `nulls`: then kernel gets None."""

    def one(args):
        if not nulls and any(a is None or a is pd.NA or (isinstance(a, float) and a != a) for a in args):
            return None
        return kernel(*args)

    def run(*cols: pd.Series) -> pd.Series:
        return pd.Series([one(a) for a in zip(*cols)], dtype=object)

    # Spark wants a fixed number of named arguments.
    arity = kernel.__code__.co_argcount - len(kernel.__defaults__ or ())
    if arity == 1:

        def fixed(a: pd.Series) -> pd.Series:
            return run(a)

    elif arity == 2:

        def fixed(a: pd.Series, b: pd.Series) -> pd.Series:
            return run(a, b)

    else:

        def fixed(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
            return run(a, b, c)

    def column(*cols):
        # Made when it is used: a UDF needs a session, and executors import this module without one.
        if spark := SparkSession.getActiveSession():
            bounded_batches(spark)
        return F.pandas_udf(fixed, kind)(*cols)

    column.udf = lambda: F.pandas_udf(fixed, kind)
    return column


#: Rows that are Python objects at one time.
STEP = 64


def arrowed(kernel: Callable, kind: str) -> Callable:
    """vectorized() for texts that become many structs: rows are Python objects STEP at a
    time and go back to Arrow, so a worker holds a batch's bytes and not its objects."""
    arity = kernel.__code__.co_argcount

    def udf():
        made = to_arrow_type(DataType.fromDDL(kind))

        def run(*arrays):
            rows = lambda at: zip(*[a.slice(at, STEP).to_pylist() for a in arrays])
            return pa.concat_arrays([pa.array([], made), *[pa.array([None if None in r else kernel(*r) for r in rows(at)], made) for at in range(0, len(arrays[0]), STEP)]])

        if arity == 1:

            def fixed(a: pa.Array) -> pa.Array:
                return run(a)

        elif arity == 2:

            def fixed(a: pa.Array, b: pa.Array) -> pa.Array:
                return run(a, b)

        else:

            def fixed(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
                return run(a, b, c)

        return F.arrow_udf(fixed, kind)

    def column(*cols):
        if spark := SparkSession.getActiveSession():
            bounded_batches(spark)
        return udf()(*cols)

    column.udf = udf
    return column
