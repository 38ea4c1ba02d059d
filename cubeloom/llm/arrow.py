"""Small portions of the batches that Spark sends, so that a worker's memory doesn't depend on the batch size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows handled together, and bytes of their strings; a longer row is a portion of its own.
PORTION, PORTION_BYTES = 200, 4 << 20


def row_bytes(batch: pa.RecordBatch) -> np.ndarray:
    """Bytes of each row's strings, binaries and lists of longs."""
    total = np.zeros(batch.num_rows, dtype=np.int64)
    for column in batch.columns:
        kind = column.type
        if pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_string(kind) or pa.types.is_large_binary(kind):
            width = 8 if pa.types.is_large_string(kind) or pa.types.is_large_binary(kind) else 4
            buffer = column.buffers()[1]
            if buffer is not None and len(column):
                offsets = np.frombuffer(buffer, dtype=np.int64 if width == 8 else np.int32, count=column.offset + len(column) + 1)[column.offset :]
                total += np.diff(offsets)
        elif pa.types.is_list(kind):
            total += 8 * np.diff(column.offsets.to_numpy())
    return total


def portions(batches: Iterator[pa.RecordBatch], rows: int = PORTION, most: int = PORTION_BYTES) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, at = batch.num_rows, 0
        ends = np.cumsum(row_bytes(batch))
        while at < n:
            before = int(ends[at - 1]) if at else 0
            fits = int(np.searchsorted(ends, before + most, side="right"))
            to = min(n, at + rows, max(at + 1, fits))
            yield batch.slice(at, to - at)
            at = to
