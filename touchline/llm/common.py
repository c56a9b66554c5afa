"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.session import ensure_checkpoint_dir


#: Spark's own switch for dropping a query's shuffle files when the query ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The session's ``key`` is ``value`` within the block, and what it was after it."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the session's shared checkpoint folder.

    Reliable ``checkpoint()`` only: a lost executor re-reads the files, and
    Spark's cleaner drops them once nothing refers to the table. Nothing reads the
    shuffles behind the table again, so their files go as soon as it is written, not when the
    driver happens to collect its garbage.
    """
    ensure_checkpoint_dir(df.sparkSession)
    with setting(df.sparkSession, SHUFFLE_CLEANUP, "true"):
        return df.select("*").checkpoint(eager=True)


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def text_slices(texts: list, limit: int = 1 << 18) -> Iterator[slice]:
    """Consecutive slices of ``texts`` with about ``limit`` bytes each (one
    longer text forms a slice of its own), so working arrays stay bounded."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > limit:
            yield slice(start, i)
            start, size = i, 0
        size += n
    if start < len(texts):
        yield slice(start, len(texts))


def binary_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as the empty text."""
    return [b if b is not None else b"" for b in batch.column(name).cast(pa.binary()).to_pylist()]


def give_back() -> None:
    """Python workers wait for later tasks: what a task has freed goes back to the system, not to the worker's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):     # not glibc
        pass


#: Texts vary from a few bytes to many pages, so a worker's batches are bounded by bytes, not by rows alone.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with a function of one batch that yields batches; sets the session's batch sizes to ``BATCH``."""
    for key, value in BATCH.items():
        df.sparkSession.conf.set(key, value)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)
        give_back()

    return df.mapInArrow(run, schema)


def whole_text(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays as one block of bytes: number, then type and length of each, then their items."""
    head = [len(arrays).to_bytes(2, "little")]
    head += [a.dtype.str.encode().ljust(4) + len(a).to_bytes(6, "little") for a in arrays]
    return b"".join([*head, *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def unpack_arrays(data: bytes) -> list[np.ndarray]:
    n = int.from_bytes(data[:2], "little")
    at, out = 2 + 10 * n, []
    for i in range(n):
        kind, size = np.dtype(data[2 + 10 * i:6 + 10 * i].decode().strip()), int.from_bytes(data[6 + 10 * i:12 + 10 * i], "little")
        out.append(np.frombuffer(data, kind, size, at))
        at += out[-1].nbytes
    return out
