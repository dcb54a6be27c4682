"""Memory of the Python workers, which Spark keeps from task to task and operator to operator."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable

import pyarrow as pa

from strandwise.llm.tokenize import encoder


def release_memory() -> None:
    """Drop the encoders this process keeps and hand freed memory back to the system."""
    encoder.cache_clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable) -> Callable:
    """A function of batches that releases what the worker holds from other operators before, and its own after."""

    def around(batches):
        release_memory()
        yield from run(batches)
        release_memory()

    return around
