"""Batches in small slices: what Python makes of the rows of a batch is many times as large as the batch."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Rows, and about the bytes of them, that a function in Python turns into objects at once.
ROWS, BYTES = 64, 1 << 20


def parts(batches: Iterator) -> Iterator:
    """Batches of columns (or of one column) in slices of ``ROWS`` rows."""
    for batch in batches:
        n = len(batch[0]) if isinstance(batch, tuple) else len(batch)
        for at in range(0, n, ROWS):
            cut = slice(at, at + ROWS)
            yield tuple(c.iloc[cut] for c in batch) if isinstance(batch, tuple) else batch.iloc[cut]


def record_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of at most ``ROWS`` rows and about ``BYTES``, one row at least."""
    for batch in batches:
        each = max(1, min(ROWS, batch.num_rows * BYTES // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, each):
            yield batch.slice(at, each)
