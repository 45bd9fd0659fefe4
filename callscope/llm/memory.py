"""Memory of reused Python workers."""

from __future__ import annotations

import ctypes

import pyarrow as pa


def give_back() -> None:
    """Hand freed memory back to the system at a task's end; workers are reused by later stages. Without effect where the C library has no malloc_trim."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
