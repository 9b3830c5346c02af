"""What a Python worker keeps between tasks: one thing at a time, so that a job of many operators stays small."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable
from typing import TypeVar

import pyarrow as pa

T = TypeVar("T")
_held: dict[Hashable, object] = {}


def resident(key: Hashable, make: Callable[[], T]) -> T:
    """The object kept under ``key``; another key drops what was kept before."""
    if key not in _held:
        _held.clear()
        trim()
        _held[key] = make()
    return _held[key]  # type: ignore[return-value]


def trim() -> None:
    """Give freed memory back to the system, where the allocators allow it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
