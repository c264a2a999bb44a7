"""Arrow batches cut by bytes, and names that don't clash."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def cuts(texts: pa.Array, most: int, rows: int = 4096) -> Iterator[tuple[int, int]]:
    """(start, stop) of runs of texts that have at most ``most`` bytes together, or one text where that alone has more."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        base = ends[at - 1] if at else 0
        stop = min(max(at + 1, int(np.searchsorted(ends, base + most, "right"))), at + rows, len(texts))
        yield at, stop
        at = stop


def free_name(name: str, taken: Iterable[str]) -> str:
    """The name, or the name with the first number that no other column has (in any case)."""
    used, tried, k = {t.lower() for t in taken}, name, 1
    while tried.lower() in used:
        tried, k = f"{name}_{k}", k + 1
    return tried


def handing_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, a function for mapInArrow, that gives back to the system what it has freed once its partition is done.

    Workers wait for the next task; what their allocators keep would be missed by stages that run in the JVM alone.
    """

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library; others have no such call
        if trim:
            trim(0)

    return own
