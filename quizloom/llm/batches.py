"""Arrow batches in slices of bounded size, so that a worker holds little at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in a slice, unless one text alone has more.
SLICE_BYTES = 1 << 21


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of the batches' rows, of about size bytes in the column text; a batch without rows gives none."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths + 64)
        at, n = 0, batch.num_rows
        while at < n:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(at, to - at)
            at = to
        del batch, lengths, ends
        pa.default_memory_pool().release_unused()
