"""What Python workers keep between tasks.

Spark hands a worker on from query to query.  Its caches would add up beside the JVM's heap, as would memory that was freed but
not given back; so a task lets go of what other operators have kept, and gives back what it has freed.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_CACHES: dict[str, dict] = {}


def cache(name: str) -> dict:
    """A dict of this worker that lasts until a task that doesn't name it."""
    return _CACHES.setdefault(name, {})


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *own: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` as a task that keeps the caches ``own`` only and leaves no freed memory behind."""

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(*own)
        try:
            yield from run(batches)
        finally:
            give_back()

    return inside


def forget(*own: str) -> None:
    """Empty all caches but ``own``."""
    dropped = [x for name, x in _CACHES.items() if x and name not in own]
    for x in dropped:
        x.clear()
    if dropped:
        give_back()


def give_back() -> None:
    """Freed memory goes back to the system, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def parts(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """A batch cut where its ``column`` of texts has ``size`` bytes, at least one row each; nothing is copied."""
    if not batch.num_rows:
        yield batch
        return
    texts = batch.column(column)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32, len(texts) + 1, (8 if pa.types.is_large_string(texts.type) else 4) * texts.offset)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, int(offsets[at]) + size, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
