"""What a Python worker remembers between tasks: the memory of one operator at a time.

Workers are used again by later stages. What an operator remembers (words and their ids, say) would stay there while the next
one works, so each task first has the other operators forget.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa

_forget: dict[str, list[Callable[[], object]]] = {}
_last: list[str] = []


def remembers(owner: str, forget: Callable[[], object]) -> None:
    """``forget`` drops what ``owner`` holds in this worker."""
    _forget.setdefault(owner, []).append(forget)


def only(owner: str) -> None:
    """Where the worker's last task was another operator's, that one forgets, and unused memory goes back to the system."""
    if _last[:] == [owner]:
        return
    _last[:] = [owner]
    for name, all_of_it in _forget.items():
        if name != owner:
            for forget in all_of_it:
                forget()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)
