"""Arrow batches in slices of bounded text, for Python tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in a slice; a longer text is a slice by itself.
SLICE_BYTES = 1_000_000


def slices(it: Iterator[pa.RecordBatch], texts: Callable[[pa.RecordBatch], pa.Array], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """All rows, in order, without copying them: what a task makes of the rows at one time follows the slice, not Spark's batch. texts: the column that is measured."""
    for batch in it:
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts(batch)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, end - at)
            at = end
    # A worker is used again by later tasks, so it gives back what this one no longer needs.
    pa.default_memory_pool().release_unused()
