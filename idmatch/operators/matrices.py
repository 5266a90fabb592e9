"""Arrow list columns as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def by_width(column: pa.Array | pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows and their matrix for each width of a list column; null lists are in none, null values are NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    width = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    return {int(w): (rows := np.flatnonzero(width == w), matrix(column.take(pa.array(rows)))) for w in np.unique(width[width > 0])}
