"""Python steps that work through Spark's batches in parts of bounded size.

A batch on its way to Python may have ten thousand pages. What Python builds of
a page (trees, lists, strings) is many times its size, so a step takes a small
part of the batch, gives back what it made of it, and forgets it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A part has so many bytes of text at most, or one row, and so many rows.
PART_BYTES, PART_ROWS = 1 << 20, 1000


def _cut(columns: tuple, part_bytes: int) -> Iterator[tuple]:
    """Slices of a batch's columns, in order."""
    rows = len(columns[0])
    sizes = np.zeros(rows, np.int64)
    for c in columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
            sizes += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes), 0
    while start < rows:
        before = ends[start - 1] if start else 0
        fits = int(np.searchsorted(ends, before + part_bytes, "right"))
        stop = min(max(fits, start + 1), start + PART_ROWS)
        yield tuple(c.slice(start, stop - start) for c in columns)
        start = stop


def by_parts(work: Callable[..., pa.Array], part_bytes: int = PART_BYTES) -> Callable:
    """`work` on one array as a function for `arrow_udf` that takes its batches in parts."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in _cut((batch,), part_bytes):
                yield work(*part)
    return run


def by_parts_of_several(work: Callable[..., pa.Array], part_bytes: int = PART_BYTES) -> Callable:
    """The same for `work` on several arrays."""
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in _cut(batch, part_bytes):
                yield work(*part)
    return run
