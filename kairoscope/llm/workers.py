"""Memory of Python workers, which outlive their tasks and serve those of later stages."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

Batches = Iterator[pa.RecordBatch]


def give_back() -> None:
    """Return memory to the system that Arrow and the allocator hold without using it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run``, after which the worker keeps no memory of the partition."""

    def tidied(batches: Batches) -> Batches:
        yield from run(batches)
        give_back()

    return tidied
