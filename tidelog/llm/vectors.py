"""Vectors as matrices, for the operators on embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each vector length of a list column: the numbers of its rows, and the
    vectors as a matrix of doubles. Vectors that are null or empty or hold null
    or non-finite components are left out."""
    size = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    start = np.cumsum(size) - size
    for dim in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == dim)
        x = flat[start[rows][:, None] + np.arange(dim)]
        good = np.isfinite(x).all(1)
        yield rows[good], x[good]


def matrix(column: pa.Array) -> np.ndarray:
    """A list column whose lists have one length, as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def lists(x: np.ndarray) -> pa.Array:
    """A matrix as a list column."""
    ends = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] if x.ndim == 2 else 0)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x.ravel()))
