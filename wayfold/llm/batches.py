"""Helpers for functions that run over Arrow batches in Python workers."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a step handles at once; a longer text is a step of its own.
CHUNK_BYTES = 1 << 20


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts add up to about ``limit`` bytes."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(size, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, before + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end


class Memo:
    """A cache with a bound: two generations, the older of which goes when the newer is full.

    A generation is full at half of ``size`` keys, or at ``load`` characters of keys: long ones are few.
    """

    def __init__(self, size: int, load: int = 8 << 20):
        self.half, self.load, self.taken, self.new, self.old = size // 2, load, 0, {}, {}

    def absent(self, keys: set) -> list:
        """Those of ``keys`` that must be computed; what is known becomes recent."""
        missing = keys.difference(self.new)
        if missing:
            self.taken += sum(map(len, missing))
        if self.old and missing:
            fresh = missing.difference(self.old)
            again = missing - fresh
            self.new.update(zip(again, map(self.old.__getitem__, again), strict=True))
            missing = fresh
        return list(missing)

    def turn(self) -> None:
        """To be called between chunks."""
        if len(self.new) > self.half or self.taken > self.load:
            self.old, self.new, self.taken = self.new, {}, 0


#: The model a worker holds; there is one at a time, as workers outlive queries.
_HELD: dict[Any, Any] = {}


def model(key: Any, make: Callable[[], Any]) -> Any:
    """What ``make`` gives for ``key``, kept until a task of this worker needs another model, or none."""
    if key not in _HELD:
        settle()
        _HELD[key] = make()
    return _HELD[key]


def settle() -> None:
    """Give back what earlier tasks of this worker left behind."""
    if _HELD:
        _HELD.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
