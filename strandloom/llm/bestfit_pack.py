"""Packing into sequences by bounded-space online best fit.

Pieces arrive one after another. A fixed number of bins is open; a bitset keyed by free
space finds the bin with the least free space that still takes a piece; a new bin opens
only when none does, and when too many are open the fullest closes first. Pieces arrive in
short runs of ``RUN`` pieces, the longest of a run first, so that short ones fill what long
ones leave; a run of one piece is plain online arrival. Pieces are dealt to tasks by a
hash of their key and place in the written pieces, so no task depends on another, copies
(whole rows, too) spread over tasks, and each task leaves only its last open bins partly
filled.

Defined cases: a null or empty text is one piece, its end id; texts over the length are
cut in pieces of full length and a rest; repeated rows are packed like any; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm._bpe import CACHE_PIECES, encoder
from strandloom.llm._shared import slices, written

OPEN_BINS = 1024
PIECES_PER_TASK = 200_000
RUN = 4096
BATCH_BYTES = 8 << 20


class BestFit:
    """Bounded-space online best fit with ``open_bins`` bins of ``capacity``."""

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.bits = 0  # bit f: some open bin has f free
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = 0
        self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for the next piece."""
        if not 0 < length <= self.capacity:
            raise ValueError(f"length {length} is not in 1..{self.capacity}")
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            own = self._take(free)
        else:
            if length < self.capacity and self.open >= self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            free, own = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:
            self.by_free[left].append(own)
            self.bits |= 1 << left
            self.open += 1
        return own, self.capacity - free

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        own = bins.pop()
        self.open -= 1
        if not bins:
            self.bits &= ~(1 << free)
        return own


def runs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of ``size`` rows, the last one smaller, however they came."""
    held: list[pa.RecordBatch] = []
    n = 0

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        while n + batch.num_rows >= size:
            held.append(batch.slice(0, size - n))
            yield joined()
            batch = batch.slice(size - n)
            held, n = [], 0
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
    if n:
        yield joined()


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, cache: int = CACHE_PIECES, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every whole text, cut at ``capacity`` ids.

    cache, batch_bytes: the word pieces that a worker remembers and the bytes of text that it
    encodes at a time; less of both takes less memory and more time.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary, end_id, cache)
        for batch in batches:
            for part in slices(batch, "text", batch_bytes):
                ids, at = own.encode(part.column("text"))
                sizes = np.diff(at)
                counts = -(-sizes // capacity)
                doc = np.repeat(np.arange(len(sizes)), counts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
                start = piece * capacity
                length = np.minimum(capacity, sizes[doc] - start)
                view = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                first = (at[doc] + start) * 4
                crc = [zlib.crc32(view[s:e]) for s, e in zip(first.tolist(), (first + length * 4).tolist(), strict=True)]
                columns = [part.column("doc_id").cast(pa.int64()).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def pack(cut: DataFrame, capacity: int, open_bins: int = OPEN_BINS, per_task: int = PIECES_PER_TASK, run: int = RUN) -> DataFrame:
    """``cut`` (doc_id, piece, length, ...) with sequence_id and offset.

    The arrival order within a task is that of a hash of the piece's key and its place in
    the written table, so a lost task gives the same bins again.
    """
    held = written(cut, "pieces")
    tasks = max(1, -(-held.count() // per_task))
    key = F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id())
    dealt = held.withColumn("_key", key).repartition(tasks, "_key").sortWithinPartitions("_key", "doc_id", "piece", "length")
    names = held.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema) + ", sequence_id long, offset long"

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bins, high = BestFit(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in runs(batches, run):
            lengths = batch.column("length").to_numpy()
            order = np.argsort(-lengths, kind="stable")
            placed = np.array([bins.place(n) for n in lengths[order].tolist()], np.int64)
            own = batch.take(pa.array(order))
            yield pa.RecordBatch.from_arrays([*(own.column(c) for c in names), pa.array(high + placed[:, 0]), pa.array(placed[:, 1].copy())], [*names, "sequence_id", "offset"])

    return dealt.mapInArrow(fill, schema)


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = 4096, open_bins: int = OPEN_BINS, cache: int = CACHE_PIECES, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    return pack(pieces(docs, vocabulary, end_id, capacity, cache, batch_bytes), capacity, open_bins)
