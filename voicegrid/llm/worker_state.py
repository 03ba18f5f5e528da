"""Objects that a Python worker keeps from one task to the next.

Functions of this package travel to the workers by value, so their module's
variables begin anew in each task.  A module of the worker's own interpreter
lives as long as the worker; a lost worker only loses time.
"""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable
from typing import Any

import pyarrow as pa

HOLDER = "_voicegrid_worker_state"


def kept(name: str, key: Any, make: Callable[[], Any]) -> Any:
    """The worker's object ``name`` for ``key``.

    One object is kept: the next operator's tasks let the former operator's go.
    """
    held = sys.modules.setdefault(HOLDER, types.ModuleType(HOLDER)).__dict__
    if held.get("key") != (name, key):
        if held.pop("made", None) is not None:
            trim()
        held["made"], held["key"] = make(), (name, key)
    return held["made"]


def let_go() -> None:
    """Drops the kept object, whatever it is."""
    held = sys.modules.setdefault(HOLDER, types.ModuleType(HOLDER)).__dict__
    held.pop("made", None)
    held.pop("key", None)
    trim()


def trim() -> None:
    """Gives freed memory back, as an idle worker lives on beside the next operator's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no such call on this platform
        pass
