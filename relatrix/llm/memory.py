"""Memory of reused Python workers: what a task has freed goes back to the system when it ends."""

from __future__ import annotations

import ctypes

import pyarrow as pa


def give_back() -> None:
    """Arrow's unused pool, and the C library's free heap where it is glibc."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass
