"""What operators hold in a Python worker process, which Spark reuses from task to task and stage to stage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa

from . import textkit

_HELD: dict[str, tuple[Any, Any]] = {}


def held(owner: str, key: Any, make: Callable[[], Any]) -> Any:
    """What ``make`` built for ``key`` in this process; an owner holds one thing at a time."""
    if _HELD.get(owner, (None,))[0] != key:
        _HELD.pop(owner, None)
        _HELD[owner] = key, make()
    return _HELD[owner][1]


def begin(owner: str) -> None:
    """Drop what other owners hold."""
    for name in [x for x in _HELD if x != owner]:
        del _HELD[name]


def give_back() -> None:
    """Return freed memory to the system: allocators keep it otherwise, beside the JVM that needs it next."""
    textkit.forget_powers()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], owner: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow`` in a process that holds nothing of other owners before it and no freed memory after it."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(owner)
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole
