"""Arrow batches of bounded bytes, for column functions that run in Python."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Bytes of an Arrow batch between JVM and Python, and of those that Python makes objects of at once. Both hold one row at least.
BATCH_BYTES, STEP_BYTES = 4 << 20, 1 << 20
SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
_lean = False


def bound() -> None:
    """Bounds the batches of the active session by bytes; a bound that it has already is kept."""
    spark = SparkSession.getActiveSession()
    if spark is not None and SETTING not in spark.conf.getAll:
        spark.conf.set(SETTING, str(BATCH_BYTES))


def lean() -> None:
    """Makes a worker give large blocks back to the system as soon as they are freed."""
    global _lean
    if _lean:
        return
    _lean = True
    try:
        libc = ctypes.CDLL("libc.so.6")
    except OSError:  # another C library: memory is returned as it likes
        return
    libc.mallopt(-3, 16 << 20)  # M_MMAP_THRESHOLD; setting it also keeps it from growing
    libc.mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD
    pa.set_memory_pool(pa.system_memory_pool())


def sizes(column: pa.Array) -> np.ndarray:
    """Bytes of each text, or of each list of 8-byte numbers; nulls have none."""
    n = pc.list_value_length(column) if pa.types.is_list(column.type) else pc.binary_length(column)
    return n.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) * (8 if pa.types.is_list(column.type) else 1)


def steps(column: pa.Array) -> Iterator[pa.Array]:
    """Slices of the column with about STEP_BYTES each, one row at least; an empty column is one slice."""
    ends, start = np.cumsum(sizes(column)), 0
    if not len(column):
        yield column
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + STEP_BYTES, "right")))
        yield column.slice(start, end - start)
        start = end


def by_steps(column: pa.Array, run) -> pa.Array:
    """run(slice) of each of the column's steps, one behind the other."""
    lean()
    made = [run(some) for some in steps(column)]
    return made[0] if len(made) == 1 else pa.concat_arrays(made)
