"""What a Python worker holds from one task to the next.

Spark gives a worker to one stage after another, so what the tasks of an earlier operator remember, and memory that
they no longer use, would lie beside all that later ones need.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable

_remembered: dict[str, Callable[[], None]] = {}


def remembers(owner: str, forget: Callable[[], None]) -> None:
    """``forget`` empties what the tasks of ``owner`` remember."""
    _remembered[owner] = forget


def give_back() -> None:
    """Memory that nothing uses goes back to the system, where its allocators can do that."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def begins(owner: str) -> None:
    """A task of ``owner`` begins: what others remember here is forgotten. What it remembers itself stays."""
    for name, forget in _remembered.items():
        if name != owner:
            forget()
    give_back()
