"""Arrow batches in workers: rows as Python objects a run at a time, and memory given back."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def pieces(batch: pa.RecordBatch, texts: int, limit: int = 1 << 19) -> Iterator[list[list]]:
    """The columns of a batch as lists, in runs of rows of at most ``limit`` bytes of its ``texts``-th column, or of one row.

    Rows become Python objects a run at a time, so a worker's memory does not follow the size of Arrow's batches.
    """
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(texts)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = done = 0
    while at < len(size):
        end = max(at + 1, int(np.searchsorted(size, done + limit, "right")))
        yield [c.slice(at, end - at).to_pylist() for c in batch.columns]
        at, done = end, int(size[end - 1])


def trimmed() -> None:
    """Gives a worker's free memory back: workers outlive their tasks, and idle ones would keep the most that they ever held."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
