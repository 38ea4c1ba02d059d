"""Arrow columns of vectors to numpy, and blocks of them in binary columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def to_matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(matrix of doubles, valid): rows that are null, empty or hold null or non-finite components are not valid.

    Shorter vectors are padded with zeros, which changes no inner product.
    """
    n = len(column)
    lists = column.cast(pa.list_(pa.float64()))
    sizes = np.diff(lists.offsets.to_numpy())
    width = int(sizes.max()) if n else 0
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    live = ~np.asarray(lists.is_null())
    sizes = np.where(live, sizes, 0)
    out = np.zeros((n, width))
    starts = np.cumsum(sizes) - sizes
    rows = np.repeat(np.arange(n), sizes)
    out[rows, np.arange(len(rows)) - np.repeat(starts, sizes)] = flat  # nulls arrive as NaN
    return out, (sizes > 0) & np.isfinite(out).all(axis=1)


def pad(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1])))
