"""Helpers for operators that work on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa


def ragged(lists: Sequence[Sequence], kind: pa.DataType) -> pa.Array:
    """A list array of many short sequences, built from one flat array."""
    sizes = np.fromiter((len(x) for x in lists), dtype=np.int64, count=len(lists))
    offsets = np.zeros(len(lists) + 1, dtype=np.int32)
    np.cumsum(sizes, out=offsets[1:])
    flat = [y for x in lists for y in x]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))


def slices(batches: Iterator[pa.RecordBatch], column: str, chars: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each piece hold about ``chars`` bytes; a longer text stands alone."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = np.array([len(x) if x is not None else 0 for x in batch.column(column).to_pylist()], dtype=np.int64)
        ends = np.cumsum(sizes)
        start, base = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, base + chars, side="right")))
            yield batch.slice(start, stop - start)
            start, base = stop, int(ends[stop - 1])
