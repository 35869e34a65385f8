"""Memory of Python workers.

Spark keeps a worker for the next task, and with it whatever its allocators hold.  Functions given to
``mapInArrow`` and ``applyInArrow`` are wrapped so that a worker returns what it no longer uses when a task ends.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import pyarrow as pa


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    """glibc's malloc_trim, where there is one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return None


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function over batches, after which the worker gives back memory."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped
