"""Arrow batches of texts in pieces, so that what Python makes of one is bounded whatever Spark's batches hold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that Python takes apart at once.
MOST = 1 << 20


def slices(batch: pa.RecordBatch, weight: str, most: int = MOST) -> Iterator[pa.RecordBatch]:
    """Runs of rows of at most so many bytes by a column of their sizes (null: none); a larger row is one by itself."""
    sizes = np.maximum(batch.column(weight).fill_null(0).to_numpy(zero_copy_only=False), 64)
    total, start = np.cumsum(sizes, dtype=np.int64), 0
    while start < batch.num_rows:
        before = int(total[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(total, before + most, side="right")))
        yield batch.slice(start, end - start)
        start = end
