"""What the operators of this package share: Arrow passes of bounded memory, and written tables."""

from __future__ import annotations

import ctypes
import os

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.plans.shared import discard, materialize, shared_path
from textmill.plans.shipping import ship

__all__ = ["discard", "few", "held", "local_file", "map_arrow", "materialize", "shared_path", "shipped_file", "steps", "utf8"]
_held: dict = {}
_lean = False

#: Bytes of text that one step of an Arrow operator works on, and of an Arrow batch between JVM
#: and Python. Both hold one row at least, so a longer text is a step of its own.
STEP_BYTES, BATCH_BYTES = 1 << 20, 4 << 20
#: Tables of at most so many bytes as a join's hash table are broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def held(key: tuple, make):
    """make()'s object, kept in a Python worker from task to task until one with another key is asked for.

    A worker serves all stages of an application; so it holds one operator's memory at a time.
    """
    if key not in _held:
        _held.clear()
        give_back()
        _held[key] = make()
    return _held[key]


def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library: memory is returned as it likes
        return None


def lean() -> None:
    """Makes a worker return very large blocks to the system as soon as they are freed; give_back() does so for the rest."""
    global _lean
    if _lean or (libc := _libc()) is None:
        return
    _lean = True
    libc.mallopt(-3, 16 << 20)  # M_MMAP_THRESHOLD; setting it also keeps it from growing
    libc.mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD
    pa.set_memory_pool(pa.system_memory_pool())


def give_back() -> None:
    """Returns freed memory to the system."""
    pa.default_memory_pool().release_unused()
    if (libc := _libc()) is not None:
        libc.malloc_trim(0)


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow(run, schema) with batches of bounded bytes and workers that return their memory.

    The bound on batches is a setting of the session; one that the session has already is kept.
    """
    spark = df.sparkSession
    ship(spark)
    if "spark.sql.execution.arrow.maxBytesPerBatch" not in spark.conf.getAll:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def bounded(batches):
        lean()
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(bounded, schema)


def shipped_file(spark: SparkSession, path: str) -> str:
    """The name under which executors find a file of the driver's, which is sent along with the application."""
    name = os.path.basename(path)
    if name not in {os.path.basename(p) for p in spark.sparkContext.listFiles}:
        spark.sparkContext.addFile(path)
    return name


def local_file(name: str) -> str:
    """Where a shipped file is, in a worker or in the driver."""
    return SparkFiles.get(name)


def few(rows: DataFrame) -> DataFrame:
    """rows, a written table, marked to be broadcast if its measured bytes in a hash table allow it."""
    width = sum((F.coalesce(F.octet_length(f.name), F.lit(0)) if f.dataType.simpleString() in ("string", "binary") else F.lit(8) for f in rows.schema.fields), F.lit(64))
    return F.broadcast(rows) if (rows.agg(F.sum(width)).first()[0] or 0) <= BROADCAST_BYTES else rows


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if pa.types.is_string(column.type) else column
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def steps(batches, text: str):
    """Slices of the record batches with about STEP_BYTES of text each, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.diff(utf8(batch.column(text))[1]))
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, done + STEP_BYTES, "right")))
            yield batch.slice(start, end - start)
            start = end
