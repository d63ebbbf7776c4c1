"""Batches of rows taken apart by their size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a task turns into Python objects at a time.
SLICE_BYTES = 1 << 20


def slices(text: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, number of rows) of runs of about SLICE_BYTES of text; a longer text starts one."""
    sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes + 1) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(sizes)]
    for first, end in zip(cuts, cuts[1:]):
        if end > first:
            yield first, end - first
