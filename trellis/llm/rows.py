"""Small helpers for row schemas."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Hashable, Iterator
from typing import TypeVar

from pyspark.sql import SparkSession
from pyspark.sql import types as T

T_ = TypeVar("T_")


def grown(schema: T.StructType, more: str) -> T.StructType:
    """A new schema with the fields of ``schema`` and those of the DDL string ``more``."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(more).fields])


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Have Spark hand texts to Python in batches of about ``most`` bytes, unless the session has
    chosen a size.

    A batch is held several times over (by the executor, on the way, and in Python), and texts vary
    from a word to a book, so bytes, not rows, must bound it.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":  # Spark's own default; a chosen value stays
        spark.conf.set(key, f"{most}b")


def _store() -> dict:
    """What this worker process keeps between tasks.

    It is looked up as the task runs: a task's functions may come pickled with their globals, which are then new for each task.
    """
    return sys.modules.setdefault("_trellis_kept", types.ModuleType("_trellis_kept")).__dict__.setdefault("kept", {})


def kept(key: Hashable, make: Callable[[], T_]) -> T_:
    """What ``make`` gave when this worker process first asked for ``key``."""
    store = _store()
    if key not in store:
        store[key] = make()
    return store[key]


def forget_kept() -> None:
    """Free what tasks before left in this worker process for their successors."""
    _store().clear()


def trim() -> None:
    """Give memory that is free, but still held by this worker process, back to the system."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if give is not None:
        give(0)


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over batches, after which its worker process, which waits for more tasks, holds no free memory."""

    def lean(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            trim()

    return lean
