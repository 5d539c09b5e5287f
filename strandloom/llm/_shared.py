"""Helpers of the training-data operators: written tables, bounded Arrow slices, folds."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from strandloom.tables import new_path, shared_dir, written

__all__ = ["fold", "new_path", "raw", "shared_dir", "slices", "texts_of", "written"]


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null ids give null."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % n


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices whose ``column`` holds about ``max_bytes`` bytes at most (one row at least)."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at, n = 0, batch.num_rows
    while at < n:
        base = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
        yield batch.slice(at, to - at)
        at = to
    release()


def release() -> None:
    """Gives freed memory back, as workers live on between tasks of different stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The text column with nulls as empty texts and 32-bit offsets that start anywhere."""
    import pyarrow.compute as pc

    return pc.fill_null(batch.column(column).cast(pa.large_string()), "")


def raw(texts: pa.Array):
    """(bytes, offsets) of a large_string array, offsets from 0."""
    import numpy as np

    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    first, last = int(offsets[0]), int(offsets[-1])
    body = np.frombuffer(data, dtype=np.uint8)[first:last] if data is not None and last > first else np.zeros(0, np.uint8)
    return body, offsets - first
