"""What a Python worker remembers from task to task, for one operator at a time."""

from __future__ import annotations

import gc

import pyarrow as pa

_held: dict = {}
_operator: str | None = None


def held(operator: str) -> dict:
    """What tasks of an operator have remembered in this process.

    Workers outlive the stages that they serve. One that turns to another operator lets go of
    what it has remembered, so that the stages of a pipeline don't add up in its memory.
    """
    global _operator
    if operator != _operator:
        _held.clear()
        _operator = operator
        gc.collect()
        pa.default_memory_pool().release_unused()
    return _held
