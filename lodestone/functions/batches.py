"""Arrow batches of bounded size for functions that run in Python."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text that a function sees at a time, or one text.
STEP_BYTES = 4 << 20


def by_bytes(batches: Iterator[pa.RecordBatch], name: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each has about ``limit`` bytes in the column
    ``name``; empty ones are left out."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0), dtype=np.int64)
        group = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        yield from (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False) if b > a)
    release()


def release() -> None:
    """Gives memory that a worker no longer uses back to the system, as workers
    live on for the tasks of other stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on exchanges at most ``STEP_BYTES`` (or
    less, where it is set so in bytes) with Python at a time; Spark's own bound
    is 64 MB, which a worker holds several times."""
    name, spark = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession
    held = spark.conf.get(name).removesuffix("b")
    if not held.isdigit() or not 0 < int(held) <= STEP_BYTES:
        spark.conf.set(name, str(STEP_BYTES))
    return df
