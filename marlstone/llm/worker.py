"""Memory of a Python worker, which outlives its tasks and serves one operator after another."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

_OWNER: list[str] = [""]
_DROPS: list[Callable[[], None]] = []


def drops(clear: Callable[[], None]) -> None:
    """Register what empties a module's remembered values."""
    _DROPS.append(clear)


def claim(owner: str) -> None:
    """Before an operator's first task here: forget what others remembered and return the memory."""
    if _OWNER[0] != owner:
        for clear in _DROPS:
            clear()
        _OWNER[0] = owner
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library keeps its own counsel
            pass
