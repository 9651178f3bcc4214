"""Caches that a Python worker keeps between its tasks, and their release when a worker turns to another operator."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

#: How to empty each cache, by the operator that fills it.
_caches: dict[str, Callable[[], object]] = {}
_filled: set[str] = set()


def cache(name: str, clear: Callable[[], object]) -> None:
    _caches[name] = clear


def turn_to(name: str | None) -> None:
    """Called as a task begins: empties the caches of all others, and gives the memory back."""
    others = _filled - {name}
    for other in others:
        _caches[other]()
    _filled.difference_update(others)
    if name in _caches:
        _filled.add(name)
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass
