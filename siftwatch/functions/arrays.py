"""Zero-copy moves between Arrow list columns and NumPy, used inside ``mapInArrow`` / ``applyInArrow`` tasks."""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa


# List elements worked on at once in one task.
MAX_ELEMENTS = 4_000_000


def release() -> None:
    """Gives back what earlier tasks of this worker left in Arrow's pool and on the C heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def _chunk(col) -> pa.Array:
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col


def ragged(col) -> tuple[np.ndarray, np.ndarray]:
    """A list column as (row number of every element, flat elements)."""
    arr = _chunk(col)
    lengths = np.diff(arr.offsets.to_numpy())
    return np.repeat(np.arange(len(arr)), lengths), arr.flatten().to_numpy(zero_copy_only=False)


def bounded(batches, *columns: int | str, most: int = MAX_ELEMENTS):
    """The batches cut so that their list columns hold about ``most`` elements at a time: a batch is limited in rows,
    but its lists can be long."""
    for batch in batches:
        size = sum(np.diff(_chunk(batch.column(c)).offsets.to_numpy()).astype(np.int64) for c in columns)
        part = np.cumsum(size) // most
        starts = np.flatnonzero(np.diff(part, prepend=-1)) if batch.num_rows else np.array([0])
        for start, end in zip(starts, np.append(starts[1:], batch.num_rows)):
            yield batch.slice(start, end - start)


def matrix(col) -> np.ndarray:
    """A list column of equally long vectors as a float64 matrix."""
    arr = _chunk(col)
    if not len(arr):
        return np.zeros((0, 0))
    return arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(arr), -1)


def lists(flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def vectors(m: np.ndarray) -> pa.Array:
    return lists(np.ascontiguousarray(m, dtype=np.float64).ravel(), np.full(len(m), m.shape[1]))


def unit_rows(m: np.ndarray) -> np.ndarray:
    return m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-8)
