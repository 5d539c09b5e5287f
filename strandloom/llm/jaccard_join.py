"""Self-join of documents on the Jaccard similarity of word n-grams, with Bayesian pruning.

1. Documents with the same n-gram set form a class; one member stands for it.
2. Classes meet where all values of a band of their MinHash signatures agree. Large
   bands are cut in blocks of BLOCK classes and BLOCK_BYTES of n-grams, about, and blocks
   meet in tiles, one task's work. A set that is sent to a tile is compared with up to a
   block of others there, so what a hot band sends falls behind what it compares.
3. Within a tile, pairs are compared a few MinHash values at a time. A pair goes as soon
   as the posterior probability that its similarity reaches the threshold is below
   ``TOLERANCE``. A pair that meets in several bands counts in the first.
4. The n-gram sets of what is left are compared exactly, in the same tiles, as bit rows
   over the n-grams that two members of the tile share. A tile gives each member's links and one edge to the least member of its component, so
   that a group of m members gives m rows and not m * m.
5. Components come from alternating large-star and small-star rounds over those edges,
   until a round changes nothing.

With 24 bands of 4 values a pair at the threshold of 0.8 misses every band with
probability 3e-6, and pairs above it with less. Sets are told apart by 128-bit hashes.

Defined cases: a text of one to four words has its words as its one n-gram; texts
without a word, and null texts, are alone (their class is their doc_id, no links);
class_id is the least doc_id of the component; repeated rows are copies; texts of any
length are read whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import _words
from strandloom.llm._shared import slices, texts_of, written

NGRAM = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4
STEP = 16
TOLERANCE = 1e-6
BLOCK = 256
BLOCK_BYTES = 16 << 20
BROADCAST_ROWS = 400_000

_rng = np.random.default_rng(23)
_A = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def ngram_set(grams: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(sorted distinct n-grams, 128-bit name of the set)."""
    own = np.unique(grams)
    return own, hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def minhash(own: np.ndarray) -> np.ndarray:
    """The signature of a non-empty set: the least value under each of the permutations."""
    x = (own >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 4096):
        np.minimum(out, (_A[:, None] * x[at : at + 4096] + _B[:, None]).min(1), out=out)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A 32-bit key for each band."""
    v = signature.reshape(BANDS, ROWS).astype(np.uint64)
    h = np.zeros(BANDS, np.uint64)
    for k in range(ROWS):
        h = _words.mix(h * np.uint64(0x9E3779B97F4A7C15) + v[:, k])
    return (h >> np.uint64(32)).astype(np.uint32).view(np.int32)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, step: int = STEP) -> list[int]:
    """For step, 2 * step, ... compared one-byte values, the fewest matches at which a pair stays."""
    j = np.linspace(0, 1, 4001)[1:-1]
    p = j + (1 - j) / 256
    out = []
    for n in range(step, BANDS * ROWS + 1, step):
        for m in range(n + 1):
            like = m * np.log(p) + (n - m) * np.log1p(-p)
            w = np.exp(like - like.max())
            if w[j >= threshold].sum() / w.sum() >= tolerance:
                out.append(m)
                break
    return out


def prune(signatures: np.ndarray, keys: np.ndarray, band: int, left: np.ndarray, right: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (left, right) that first meet in ``band`` and are not ruled out by their values."""
    if band:
        new = ~(keys[left, :band] == keys[right, :band]).any(1)
        left, right = left[new], right[new]
    matches = np.zeros(len(left), np.int32)
    for k, m in enumerate(least):
        s = slice(k * STEP, (k + 1) * STEP)
        matches += (signatures[left, s] == signatures[right, s]).sum(1, dtype=np.int32)
        stays = matches >= m
        left, right, matches = left[stays], right[stays], matches[stays]
    return left, right


def verify(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Whether each pair's exact Jaccard similarity reaches the threshold."""
    t = Fraction(str(threshold))
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    ok = np.zeros(len(left), bool)
    some = np.flatnonzero(np.minimum(sizes[left], sizes[right]) * t.denominator >= np.maximum(sizes[left], sizes[right]) * t.numerator)
    if not len(some):
        return ok
    _, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # n-grams of one member are in no intersection
    column = np.where(counts > 1, np.cumsum(counts > 1) - 1, -1)[place]
    width = int((counts > 1).sum())
    rows = np.zeros((len(sets), -(-width // 64)), np.uint64)
    at = np.concatenate(([0], np.cumsum(sizes)))
    for k in range(len(sets)):
        own = column[at[k] : at[k + 1]]
        bits = np.zeros(rows.shape[1] * 64, np.uint8)
        bits[own[own >= 0]] = 1
        rows[k] = np.packbits(bits, bitorder="little").view(np.uint64)
    step = max(1, (4 << 20) // max(1, rows.shape[1] * 8))
    for k in range(0, len(some), step):
        pairs = some[k : k + step]
        common = np.bitwise_count(rows[left[pairs]] & rows[right[pairs]]).sum(1, dtype=np.int64)
        union = sizes[left[pairs]] + sizes[right[pairs]] - common
        ok[pairs] = common * t.denominator >= union * t.numerator
    return ok


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least member of each member's component."""
    root = np.arange(n)
    while len(left):
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        root = root[root]
        if (before == root).all():
            break
    return root


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            hashes, at = _words.words(texts_of(part))
            grams, at = _words.ngrams(hashes, at, NGRAM, short=True)
            name_of, size, bands, signature = [], [], [], []
            for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if s == e:
                    name_of.append(None), size.append(0), bands.append(None), signature.append(None)
                    continue
                own, name = ngram_set(grams[s:e])
                values = minhash(own)
                name_of.append(name), size.append(len(own)), bands.append(band_keys(values)), signature.append(values.astype(np.uint8).tobytes())
            columns = [part.column("doc_id").cast(pa.int64()), part.column("_text"), pa.array(name_of, pa.binary()), pa.array(size, pa.int32()), pa.array(bands, pa.list_(pa.int32())), pa.array(signature, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "_text", "name", "size", "bands", "signature"])


def _tiles(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """The rows of each tile of a partition that is in order of tiles."""
    held: tuple | None = None
    rows: dict[str, list] = {}
    for batch in batches:
        tiles = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")], 1)
        cuts = np.concatenate(([0], np.flatnonzero((tiles[1:] != tiles[:-1]).any(1)) + 1, [batch.num_rows])) if batch.num_rows else [0]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            tile = tuple(tiles[s].tolist())
            if tile != held:
                if held is not None:
                    yield held, rows
                held, rows = tile, {c: [] for c in columns}
            for c in columns:
                rows[c] += batch.column(c).slice(s, e - s).to_pylist()
    if held is not None:
        yield held, rows


def _pairs_of(i: int, j: int, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if i == j:
        return np.triu_indices(len(blocks), 1)
    a, b = np.flatnonzero(blocks == i), np.flatnonzero(blocks == j)
    return np.repeat(a, len(b)), np.tile(b, len(a))


def _candidates(least: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, i, j), rows in _tiles(batches, ["node", "block", "copies", "bands", "signature"]):
            n = len(rows["node"])
            left, right = _pairs_of(i, j, np.array(rows["block"]))
            signatures = np.frombuffer(b"".join(rows["signature"]), np.uint8).reshape(n, BANDS * ROWS)
            left, right = prune(signatures, np.array(rows["bands"], np.int32), key >> 32, left, right, least)
            if not len(left):
                continue
            stay = np.unique(np.concatenate((left, right)))
            place = np.zeros(n, np.int64)
            place[stay] = np.arange(len(stay))
            # partners as bits of the tile's places, so that m members give m rows
            masks = np.zeros((len(stay), len(stay)), np.uint8)
            masks[place[left], place[right]] = 1
            packed = np.packbits(masks, axis=1, bitorder="little")
            columns = [[key] * len(stay), [i] * len(stay), [j] * len(stay), range(len(stay)), [rows["node"][k] for k in stay], [rows["copies"][k] for k in stay], [p.tobytes() for p in packed]]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "i", "j", "place", "node", "copies", "partners"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            hashes, at = _words.words(texts_of(part))
            grams, at = _words.ngrams(hashes, at, NGRAM, short=True)
            made = [ngram_set(grams[s:e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            wanted = part.column("name").to_pylist()
            keep = [k for k, (_, name) in enumerate(made) if name == wanted[k]]
            yield pa.RecordBatch.from_arrays([part.column("node").take(pa.array(keep, pa.int64())), pa.array([made[k][0].tobytes() for k in keep], pa.binary())], ["node", "grams"])


def _links(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _tiles(batches, ["place", "node", "copies", "partners", "grams"]):
            n = len(rows["node"])
            order = np.argsort(rows["place"])
            node = np.array(rows["node"], np.int64)[order]
            copies = np.array(rows["copies"], np.int64)[order]
            packed = np.frombuffer(b"".join(rows["partners"][k] for k in order), np.uint8).reshape(n, -1)
            left, right = np.nonzero(np.unpackbits(packed, axis=1, bitorder="little")[:, :n])
            ok = verify([np.frombuffer(rows["grams"][k], np.uint64) for k in order], left, right, threshold)
            left, right = left[ok], right[ok]
            if not len(left):
                continue
            links = np.bincount(left, copies[right], n) + np.bincount(right, copies[left], n)
            by_name = np.argsort(node)
            rank = np.argsort(by_name)
            root = node[by_name[roots(n, rank[left], rank[right])[rank]]]
            has = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(node[has]), pa.array(links[has].astype(np.int64)), pa.array(root[has])], ["node", "links", "root"])

    return run


def components(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """(node, root): the least node of each node's component. edges: (node, root) pairs.

    Rounds go on until one changes nothing; the number needed grows with the logarithm of
    the longest chain. Beyond ``rounds`` it raises, and never returns unfinished components.
    """
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first())
    e = written(edges.where("node <> root").select(F.greatest("node", "root").alias("node"), F.least("node", "root").alias("root")).distinct(), "edges")
    seen = mark(e)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = e.unionByName(e.select(F.col("root").alias("node"), F.col("node").alias("root")))
        # the least neighbours are written first: joins are then plain, and a hub's many rows can be split
        low = written(both.groupBy("node").agg(F.least(F.col("node"), F.min("root")).alias("low")), "lows")
        large = written(both.where("root > node").join(low, "node").select(F.col("root").alias("node"), F.col("low").alias("root")).distinct(), "edges")
        small = large.join(written(large.groupBy("node").agg(F.min("root").alias("low")), "lows"), "node")
        e = small.select(F.explode(F.array(F.struct("node", F.col("low").alias("root")), F.struct(F.col("root").alias("node"), F.col("low").alias("root")))).alias("e")).select("e.*").where("node <> root").distinct()
        e = written(e, "edges")
        now = mark(e)
        if now == seen:
            return e
        seen = now
    if seen[0]:
        raise RuntimeError(f"components have not converged in {rounds} rounds")
    return e


def join_classes(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(documents as doc_id, _text, name; classes as name, copies, links, class_id, first).

    first: the least (doc_id, text hash) of the class's rows with a doc_id.
    """
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = mine.withColumn("_text", F.xxhash64("text"))
    sketch = written(keyed.mapInArrow(_sketch, "doc_id long, _text long, name binary, size int, bands array<int>, signature binary"), "sketches")
    known = sketch.where("name IS NOT NULL")
    who = F.struct(F.coalesce("doc_id", F.lit(0)).alias("id"), "_text")
    nodes = known.groupBy("name").agg(F.first("size").alias("size"), F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"), F.min(who).alias("who"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "_text"))).alias("first"), F.first("bands").alias("bands"), F.first("signature").alias("signature"))
    # a class's number is fixed by being written
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "classes")

    band = nodes.select("node", "size", F.posexplode("bands").alias("band", "value"))
    band = band.select("node", "size", F.expr("shiftleft(CAST(band AS BIGINT), 32) | (CAST(value AS BIGINT) & 4294967295)").alias("key"))
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") * 8 / BLOCK_BYTES)).cast("int")
    shared = written(band.groupBy("key").agg(F.count(F.lit(1)).alias("count"), blocks.alias("blocks")).where("count > 1").drop("count"), "bands")
    met = band.join(shared, "key").select("key", "node", "blocks")
    met = met.join(nodes.select("node", "copies", "bands", "signature"), "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiled = met.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "block", "copies", "bands", "signature")
    ordered = tiled.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    candidates = written(ordered.mapInArrow(_candidates(least_matches(threshold)), "key long, i int, j int, place int, node long, copies long, partners binary"), "candidates")

    wanted = written(candidates.select("node").distinct().join(nodes.select("node", "name", "who"), "node").select("node", "name", F.col("who.id").alias("_id"), F.col("who._text").alias("_text")), "wanted")
    small = wanted.count() <= BROADCAST_ROWS  # five longs a row; larger ones are joined by a shuffle
    texts = mine.select(F.coalesce("doc_id", F.lit(0)).alias("_id"), F.xxhash64("text").alias("_text"), "text")
    sets = texts.join(F.broadcast(wanted) if small else wanted, ["_id", "_text"]).select("node", "name", "text").mapInArrow(_sets, "node long, grams binary").dropDuplicates(["node"])
    full = candidates.join(sets, "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "place")
    found = written(full.mapInArrow(_links(threshold), "node long, links long, root long"), "links")

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = components(found.select("node", "root").distinct())
    owned = nodes.select("node", "name", "copies", "least", "first").join(parts, "node", "left").join(links, "node", "left")
    owned = owned.select("name", "copies", "least", "first", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    owned = written(owned, "owned")
    names = owned.groupBy("root").agg(F.min("least").alias("class_id"), F.min("first").alias("first"))
    classes = written(owned.drop("first").join(names, "root").select("name", "copies", "links", "class_id", "first"), "named")
    return sketch.select("doc_id", "_text", "name"), classes


def join_documents(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, n_links (documents at the threshold or over, copies too) for each document."""
    members, classes = join_classes(docs, threshold)
    out = members.join(classes, "name", "left")
    links = F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), links.alias("n_links"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each class only: of the least doc_id, then of the least text hash.

    Rows without a doc_id stay; rows of one doc_id and text are kept once. What is kept is
    a doc_id with its text, so of a doc_id with several texts each stays that is its
    class's first, and no other.
    """
    members, classes = join_classes(docs, threshold)
    kept = F.col("name").isNull() | ((F.col("doc_id") == F.col("first.doc_id")) & (F.col("_text") == F.col("first._text")))
    found = members.where("doc_id IS NOT NULL").join(classes.select("name", "first"), "name", "left")
    found = found.groupBy(F.col("doc_id").alias("_kept_doc_id"), F.col("_text").alias("_kept_text")).agg(F.max(kept).alias("_kept"), F.count(F.lit(1)).alias("_rows"))
    found = written(found, "kept")
    same = (F.col("doc_id") == F.col("_kept_doc_id")) & (F.xxhash64("text") == F.col("_kept_text"))
    gone = found.where("NOT _kept").select("_kept_doc_id", "_kept_text")
    small = gone.count() <= BROADCAST_ROWS  # two longs a row; larger ones are joined by a shuffle
    left = docs.join(F.broadcast(gone) if small else gone, same, "left_anti")
    several = found.where("_kept AND _rows > 1").select("_kept_doc_id", "_kept_text")
    if several.isEmpty():
        return left
    once = left.join(several, same, "left_anti")
    return once.unionByName(left.join(several, same, "left_semi").dropDuplicates(["doc_id", "text"]))
