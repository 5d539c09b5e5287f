"""Token ids in binary files whose document boundaries are Elias-Fano encoded.

A segment file is one concatenated little-endian id array (2 or 4 bytes an id, by the
vocabulary's size), the end offsets of its documents as an Elias-Fano sequence, and the
ascending document ids as another. Low bits are packed, high bits are in unary, with a
sampled select table over the unary vector: ``select(i)`` gives any offset without a table
of 64-bit offsets, and a reader of one document fetches the file's head and that
document's ids, nothing else.

Texts are encoded where they lie; only their ids (about half the bytes) are shuffled
into ranges of doc_id. A task writes its files in the shared folder under names of its
attempt and renames them when whole; the manifest, a table that Spark writes, lists the
files of the attempts that counted, so retried or lost tasks leave no part of a result.
Files go through Arrow's file systems (local and mounted paths, hdfs, s3, gs, abfs).

Defined cases: null and empty texts are their end id alone; null ids come first;
repeated ids are in any order; a text of any length lies in one segment; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm._bpe import encoder
from strandloom.llm._shared import new_path, slices, written

MAGIC = b"SLEF0002"
SAMPLE = 64
SEGMENT_TOKENS = 1 << 21
#: Bytes of texts whose ids a task sorts and writes, until there are PARTS_MOST tasks.
PART_BYTES = 16 << 20
PARTS_MOST = 20_000
CACHE_PIECES = 700_000
_HEAD = struct.Struct("<8sQQqQQQB7x")
_INDEX_HEAD = struct.Struct("<QQBQQ7x")


class EliasFano:
    """A non-decreasing sequence of n unsigned integers up to u in about 2 + log2(u / n) bits each."""

    def __init__(self, n: int, u: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.u, self.low_bits, self.low, self.high, self.samples = n, u, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values).astype(np.uint64)
        n, u = len(v), int(v[-1]) if len(v) else 0
        bits = max(0, (u // max(n, 1)).bit_length() - 1)
        low = v & np.uint64((1 << bits) - 1)
        packed = np.packbits(((low[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little") if bits else np.zeros(0, np.uint8)
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(-(-((int(ones[-1]) if n else 0) + 1) // 64) * 64, np.uint8)
        unary[ones] = 1
        return cls(n, u, bits, packed, np.packbits(unary, bitorder="little").view("<u8"), ones[::SAMPLE].astype("<u4"))

    def select(self, i: int) -> int:
        """Value number i: from the sample before it over whole words of the unary vector."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        k = at >> 6
        word = int(self.high[k]) >> (at & 63) << (at & 63)
        while (c := word.bit_count()) <= left:
            left -= c
            k += 1
            word = int(self.high[k])
        for _ in range(left):
            word &= word - 1
        place = k * 64 + (word & -word).bit_length() - 1
        return (place - i) << self.low_bits | self._low(i)

    def _low(self, i: int) -> int:
        if not self.low_bits:
            return 0
        s = i * self.low_bits
        chunk = int.from_bytes(self.low[s >> 3 : (s + self.low_bits + 7) >> 3].tobytes(), "little")
        return chunk >> (s & 7) & ((1 << self.low_bits) - 1)

    def first_of(self, value: int) -> int:
        """The first place whose value is ``value`` or more, by binary search over select."""
        low, high = 0, self.n
        while low < high:
            middle = (low + high) // 2
            if self.select(middle) < value:
                low = middle + 1
            else:
                high = middle
        return low

    def all(self) -> np.ndarray:
        """All values at once."""
        ones = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits and self.n:
            bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
            out |= (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)
        return out

    def to_bytes(self) -> bytes:
        return _INDEX_HEAD.pack(self.n, self.u, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.astype("<u8").tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, u, bits, a, b = _INDEX_HEAD.unpack_from(data)
        at = _INDEX_HEAD.size
        low, high = np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, "<u8", b, at + a)
        return cls(n, u, bits, low, high, np.frombuffer(data, "<u4", -(-n // SAMPLE), at + a + 8 * b))


def encode_segment(doc_ids: np.ndarray, nulls: int, ends: np.ndarray, ids: np.ndarray, wide: bool) -> bytes:
    """A segment: head, ends and document ids in Elias-Fano form, id array. The first ``nulls`` documents have no id."""
    known = doc_ids[nulls:].astype(np.int64)
    least = int(known[0]) if len(known) else 0
    index = EliasFano.of(ends).to_bytes()
    # differences of signed ids are right as unsigned ones, whatever their signs
    names = EliasFano.of(known.view(np.uint64) - np.array([least], np.int64).view(np.uint64)).to_bytes()
    head = _HEAD.pack(MAGIC, len(doc_ids), nulls, least, len(ids), len(index), len(names), 4 if wide else 2)
    return head + index + names + ids.astype("<u4" if wide else "<u2").tobytes()


class Segment:
    """A segment over anything that can be read at a place: ``read(at, size)``."""

    def __init__(self, read):
        self.read = read
        magic, self.documents, self.nulls, self.least, self.tokens, size, names, self.width = _HEAD.unpack(bytes(read(0, _HEAD.size)))
        if magic != MAGIC:
            raise ValueError("no token segment")
        both = bytes(read(_HEAD.size, size + names))
        self.index, self.names = EliasFano.from_bytes(both[:size]), EliasFano.from_bytes(both[size:])
        self.at = _HEAD.size + size + names

    @classmethod
    def of_bytes(cls, data: bytes) -> Segment:
        return cls(lambda at, size: data[at : at + size])

    def doc_ids(self) -> list[int | None]:
        """The ids of the documents in order."""
        known = (self.names.all() + np.array([self.least], np.int64).view(np.uint64)).view(np.int64)
        return [None] * self.nulls + known.tolist()

    def offset(self, i: int) -> int:
        """Where document i begins."""
        return self.index.select(i - 1) if i else 0

    def document(self, i: int) -> np.ndarray:
        start, end = self.offset(i), self.index.select(i)
        return np.frombuffer(self.read(self.at + start * self.width, (end - start) * self.width), "<u2" if self.width == 2 else "<u4")

    def with_id(self, doc_id: int) -> list[np.ndarray]:
        """The documents of this id."""
        k, out = self.names.first_of(max(0, doc_id - self.least)), []
        while k < self.names.n and self.least + self.names.select(k) == doc_id:
            out.append(self.document(self.nulls + k))
            k += 1
        return out


def _opened(path: str):
    """(file system, path there) of a qualified path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)


def open_segment(path: str) -> Segment:
    """A stored segment; its file is read at the places asked for."""
    system, at = _opened(path)
    file = system.open_input_file(at)
    return Segment(lambda start, size: file.read_at(size, start))


class Ranges:
    """Ranges of doc_id of about equal rows, from ``cuts`` (quantiles of the known ids, in order).

    Rows without an id come first, over ``null_parts`` ranges. An id that stands at several
    cuts, as one that a third of the rows have, spreads over the ranges between them.
    """

    def __init__(self, cuts: list[int], null_parts: int):
        self.cuts, self.null_parts = np.array(cuts, np.int64), null_parts
        self.parts = null_parts + len(cuts) + 1

    def of(self, doc_ids: pa.Array, spread: np.ndarray) -> np.ndarray:
        """The range of each row; ``spread``: any non-negative number of the row."""
        ids = doc_ids.fill_null(0).to_numpy(zero_copy_only=False)
        low, high = np.searchsorted(self.cuts, ids, "left"), np.searchsorted(self.cuts, ids, "right")
        part = self.null_parts + low + spread % (high - low + 1)
        if doc_ids.null_count:
            null = doc_ids.is_null().to_numpy(zero_copy_only=False)
            part[null] = spread[null] % self.null_parts
        return part


def ranges(docs: DataFrame) -> Ranges:
    """Ranges of about PART_BYTES of text each: one pass over the sizes, one over the ids."""
    rows, known, size = docs.agg(F.count(F.lit(1)), F.count("doc_id"), F.sum(F.octet_length("text"))).first()
    parts = max(1, min(-(-(size or 0) // PART_BYTES), PARTS_MOST))
    null_parts = -(-(rows - known) * parts // rows) if rows else 0
    cuts: list[int] = []
    if known and parts > 1:
        own = max(1, parts - null_parts)
        share = F.lit([k / own for k in range(1, own)])
        cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), share, max(10_000, 20 * own))).first()[0] if own > 1 else []
    return Ranges(sorted(cuts), null_parts)


def token_ids(docs: DataFrame, vocabulary: str, end_id: int, into: Ranges, special_as_text: bool = False) -> DataFrame:
    """part, doc_id, tokens, wide, ids of every whole text, encoded where it lies."""
    schema = "part int, doc_id long, tokens long, wide boolean, ids binary"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary, end_id, CACHE_PIECES, special_as_text)
        wide = own.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16 or end_id >= 1 << 16
        for batch in batches:
            for some in slices(batch, "text", 8 << 20):
                ids, at = own.encode(some.column("text"))
                body = ids.astype("<u4" if wide else "<u2").tobytes()
                places = at * (4 if wide else 2)
                cells = [body[a:b] for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True)]
                doc_ids = some.column("doc_id").cast(pa.int64())
                part = into.of(doc_ids, some.column("spread").to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), doc_ids, pa.array(np.diff(at), pa.int64()), pa.array([wide] * len(cells)), pa.array(cells, pa.binary())], schema.replace(",", "").split()[::2])

    place = F.xxhash64(F.monotonically_increasing_id()).bitwiseAND((1 << 62) - 1).alias("spread")
    return docs.select("doc_id", "text", place).mapInArrow(encode, schema)


def write_segments(docs: DataFrame, vocabulary: str, end_id: int, segment_tokens: int = SEGMENT_TOKENS, special_as_text: bool = False) -> DataFrame:
    """Writes the files; gives their manifest: part, segment, path, documents, tokens, first_id, last_id."""
    spark = docs.sparkSession
    into = ranges(docs)
    coded = token_ids(docs, vocabulary, end_id, into, special_as_text)
    # a range is one partition, by its number
    ordered = coded.repartitionById(into.parts, F.col("part")).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(new_path(spark, "token-files"))
    folder = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    system, at = _opened(folder)
    system.create_dir(at, recursive=True)
    schema = "part int, segment int, path string, documents long, tokens long, first_id long, last_id long"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, at = _opened(folder)
        held: list[tuple] = []
        n = segment = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, n, segment
            doc_ids = pa.concat_arrays([d for d, _, _, _ in held])
            nulls = doc_ids.null_count
            wide = held[0][3]
            ids = np.frombuffer(b"".join(b for _, _, b, _ in held), "<u4" if wide else "<u2")
            blob = encode_segment(doc_ids.fill_null(0).to_numpy(), nulls, np.cumsum(np.concatenate([t for _, t, _, _ in held])), ids, wide)
            name = f"s{task.partitionId():07d}-{segment:05d}-{task.taskAttemptId()}.slef"
            with system.open_output_stream(f"{at}/_{name}") as out:
                out.write(blob)
            system.move(f"{at}/_{name}", f"{at}/{name}")
            known = doc_ids[nulls:]
            row = [[task.partitionId()], [segment], [f"{folder}/{name}"], [len(doc_ids)], [n], [known[0].as_py() if len(known) else None], [known[-1].as_py() if len(known) else None]]
            held, n, segment = [], 0, segment + 1
            kinds = (pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 4)
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], schema.replace(",", "").split()[::2])

        for batch in batches:
            for some in slices(batch, "ids", 2 * segment_tokens):
                tokens = some.column("tokens").to_numpy()
                held.append((some.column("doc_id"), tokens, b"".join(some.column("ids").to_pylist()), some.column("wide")[0].as_py()))
                n += int(tokens.sum())
                if n >= segment_tokens:
                    yield flush()
        if held:
            yield flush()

    return written(ordered.select("doc_id", "tokens", "wide", "ids").mapInArrow(write, schema), "token-manifest")


def read_segments(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document: its place by select, its ids from the file."""
    small = manifest.select("part", "segment", "tokens")
    # ids before a segment: those of earlier parts (one row each) and of earlier segments of its part
    before = lambda *by: (Window.partitionBy(*by) if by else Window).orderBy("part" if not by else "segment").rowsBetween(Window.unboundedPreceding, -1)
    parts = small.groupBy("part").agg(F.sum("tokens").alias("_t")).select("part", F.coalesce(F.sum("_t").over(before()), F.lit(0)).alias("_p"))
    base = small.join(F.broadcast(parts), "part").select("part", "segment", (F.col("_p") + F.coalesce(F.sum("tokens").over(before("part")), F.lit(0))).alias("base"))
    placed = manifest.join(base, ["part", "segment"]).select("path", "base")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                s = open_segment(path)
                at, crc = [0], []
                body = s.read(s.at, s.tokens * s.width)  # the file is read in one go, document by document from there
                kind = "<u2" if s.width == 2 else "<u4"
                for i in range(s.documents):
                    at.append(s.index.select(i))
                    own = np.frombuffer(body, kind, at[-1] - at[-2], at[-2] * s.width)
                    crc.append(zlib.crc32(own.astype("<u4").data))
                ends = np.array(at, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids(), pa.int64()), pa.array(ends[:-1] + start), pa.array(np.diff(ends)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = manifest.count()
    tasks = max(1, min(files, max(4 * manifest.sparkSession.sparkContext.defaultParallelism, files // 16)))
    return placed.repartition(tasks).mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_document(manifest: DataFrame, doc_id: int) -> list[np.ndarray]:
    """The ids of every document of this id: of each file that may hold it, the head and those ids."""
    rows = manifest.where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)).orderBy("part", "segment").select("path")
    return [ids for r in rows.toLocalIterator() for ids in open_segment(r["path"]).with_id(doc_id)]


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = 2, segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    return read_segments(write_segments(docs, vocabulary, end_id, segment_tokens))
