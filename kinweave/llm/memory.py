"""Memory of Python workers, which Spark hands from one operator's tasks to the next.

An operator that remembers things from task to task registers how to forget them; one that needs room calls `forget`
when a task begins.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa

_FORGETTING: list[Callable[[], None]] = []


def remembers(forget: Callable[[], None]) -> None:
    """Registers what to call to drop an operator's memos in this process."""
    _FORGETTING.append(forget)


def forget() -> None:
    """Drops all registered memos and gives freed memory back to the system, where the C library can."""
    for own in _FORGETTING:
        own()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return
