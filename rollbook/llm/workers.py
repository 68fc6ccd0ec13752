"""What a reused Python worker keeps from task to task: one thing, until a task of another kind lets it go."""

from __future__ import annotations

import gc
from collections.abc import Callable, Hashable
from typing import Any

_KEPT: dict[Hashable, Any] = {}


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """What was made for ``key`` by an earlier task of this worker, or made now in place of what it kept for others."""
    if key not in _KEPT:
        free()
        _KEPT[key] = make()
    return _KEPT[key]


def free() -> None:
    """Let go of what earlier tasks kept: those of another operator need the room."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()
