"""Objects that a Python worker process keeps between tasks, such as a loaded tokenizer.

Functions arrive on a worker by value, with fresh module globals for every task, so what
should outlive a task is kept in a module of its own in ``sys.modules``.
"""

from __future__ import annotations

import ctypes
import functools
import sys
import types
from collections.abc import Callable, Hashable, Iterator

import pyarrow as pa


def kept(key: Hashable, make: Callable[[], object]):
    holder = sys.modules.setdefault("_parapet_llm_state", types.ModuleType("_parapet_llm_state"))
    found = holder.__dict__.setdefault("objects", {})
    if key not in found:
        found[key] = make()
    return found[key]


def settled(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` on the batches of a task, after which freed memory goes back to the system, where the C library can.

    Workers live on beside the tasks of later stages and share an executor's memory with them.
    """
    @functools.wraps(work)
    def run(batches):
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return run
