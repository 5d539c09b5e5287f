"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

1. Every word n-gram of the benchmark is counted over the whole corpus, with a 64-bit
   sketch of how many different surroundings (word before and after) it is seen in. So a
   passage that a third of the documents copy stays rare: it has few surroundings.
2. An item's seeds are the rarest third of its n-grams that occur at all, by surroundings,
   ties by hash. One hit of a seed joins a text to the item. Its other n-grams join them by
   two hits on nearly one diagonal, but for those of the language (``COMMON`` sketch bits
   or more), which join nothing. So common phrases start no alignment, and a copy whose
   seeds are all broken by edits is still found by what it keeps.
3. The passages around those hits are aligned with the item's words (match +2, mismatch
   -1, gap -1). A text is contaminated by an item when the score reaches that of half of
   the item's words, or of ``ENOUGH`` words for long items.

Out of reach are copies that keep no three words in a row, or one such n-gram only that is
no seed. Texts are known by a 128-bit hash: equal ones are one row until the end. Seeds
and hits meet in a join by n-gram, whatever the benchmark's size, in two passes over the
documents; texts that join an item are read once more. Tasks hold a Bloom filter of the
benchmark's n-grams of FILTER_MOST bits at most and never the benchmark.

Defined cases: null and empty texts are clean, as is everything against an empty
benchmark; items without words or without an id are skipped; items of fewer words than
an n-gram have all their words as one seed and must be there whole; equal items each
give a row; texts of any length are read whole; repeated rows give repeated rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm import _words
from strandloom.llm._shared import slices, texts_of, written

NGRAM = 3
MATCH, MISMATCH, GAP = 2, -1, -1
SHARE = 0.5
ENOUGH = 40
#: The share of an item's n-grams that are seeds, and how many sketch bits make an n-gram common.
RARE = 3
COMMON = 24
FILTER_LEAST, FILTER_MOST = 22, 27
#: Keys of texts up to which a join may broadcast them (two longs each).
BROADCAST_ROWS = 400_000
_SHORT = {m: np.uint64(0x9E3779B97F4A7C15 * m % (1 << 64)) for m in range(1, NGRAM)}
_KEY = ["t1", "t2"]


class Filter:
    """A Bloom filter of n-gram hashes, with two bits for each."""

    def __init__(self, bits: int, table: bytes):
        self.bits, self.table = bits, np.frombuffer(table, np.uint8)

    @staticmethod
    def places(grams: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        return (grams >> np.uint64(64 - bits)).astype(np.int64), (grams & np.uint64((1 << bits) - 1)).astype(np.int64)

    @classmethod
    def of(cls, grams: DataFrame) -> Filter:
        """From the column ``gram``; tasks make partial tables, of which there are eight at most."""
        n = grams.count()
        bits = min(max(FILTER_LEAST, (16 * n).bit_length()), FILTER_MOST)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = np.zeros(1 << bits, bool)
            for batch in batches:
                for at in cls.places(batch.column("gram").to_numpy().view(np.uint64), bits):
                    own[at] = True
            yield pa.RecordBatch.from_arrays([pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())], ["table"])

        table = np.zeros((1 << bits) >> 3, np.uint8)
        for row in grams.select("gram").coalesce(8).mapInArrow(part, "table binary").toLocalIterator():
            table |= np.frombuffer(row["table"], np.uint8)
        return cls(bits, table.tobytes())

    def among(self, grams: np.ndarray) -> np.ndarray:
        """Places of the n-grams that may be in the filter."""
        if not len(grams):
            return np.zeros(0, np.int64)
        first, second = self.places(grams, self.bits)
        some = np.flatnonzero(self.table[first >> 3] >> (first & 7).astype(np.uint8) & 1)
        second = second[some]
        return some[(self.table[second >> 3] >> (second & 7).astype(np.uint8) & 1).astype(bool)]


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """key, item_id, words, hashes of each item with words, written."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, at = _words.words(texts_of(part))
                cells = [hashes[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("item_id").cast(pa.int64()), pa.array(np.diff(at), pa.int32()), pa.array(cells, pa.binary())], ["item_id", "words", "hashes"])

    rows = benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "text")
    made = rows.mapInArrow(hashed, "item_id long, words int, hashes binary").where("words > 0")
    return written(made.withColumn("key", F.monotonically_increasing_id()), "items")


def item_grams(items: DataFrame) -> DataFrame:
    """key, place, gram, short of every n-gram of the items; a short item is one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, cell in zip(batch.column("key").to_pylist(), batch.column("hashes").to_pylist(), strict=True):
                hashes = np.frombuffer(cell, np.uint64)
                size = min(len(hashes), NGRAM)
                grams = _words.ngrams(hashes, np.array([0, len(hashes)]), size)[0]
                short = size < NGRAM
                grams = (grams ^ _SHORT[size] if short else grams).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(grams), pa.int64()), pa.array(np.arange(len(grams)), pa.int32()), pa.array(grams), pa.array([short] * len(grams))], ["key", "place", "gram", "short"])

    return written(items.select("key", "hashes").mapInArrow(cut, "key long, place int, gram long, short boolean"), "item-grams")


def text_hits(hashes: np.ndarray, at: np.ndarray, known: Filter, short: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, word, n-gram, sketch bit) of the n-grams of a batch that may be the benchmark's; short ones once a text."""
    grams, gram_at = _words.ngrams(hashes, at, NGRAM)
    hit = known.among(grams)
    text = np.searchsorted(gram_at, hit, side="right") - 1
    word = hit - gram_at[text]
    start = at[text] + word
    around = np.concatenate(([0], hashes, [0])).astype(np.uint64)
    before = np.where(word > 0, around[start], 0).astype(np.uint64)
    after = np.where(start + NGRAM < at[text + 1], around[np.minimum(start + NGRAM + 1, len(around) - 1)], 0).astype(np.uint64)
    bit = (_words.mix(before * np.uint64(0x9E3779B97F4A7C15) + after) >> np.uint64(58)).astype(np.int64)
    out = [(text, word, grams[hit], bit)]
    for m in short:
        grams, gram_at = _words.ngrams(hashes, at, m)
        grams = grams ^ _SHORT[m]
        hit = known.among(grams)
        text = np.searchsorted(gram_at, hit, side="right") - 1
        first = np.unique(np.stack((text.astype(np.uint64), grams[hit])), axis=1, return_index=True)[1] if len(hit) else hit
        out.append((text[first], (hit - gram_at[text])[first], grams[hit][first], np.zeros(len(first), np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def gram_counts(texts: DataFrame, known: Filter, short: list[int]) -> DataFrame:
    """gram, n, bits of the benchmark's n-grams in the corpus: how often, and the sketch of their surroundings."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                _, _, grams, bit = text_hits(*_words.words(texts_of(part)), known, short)
                if len(grams):
                    order = np.argsort(grams, kind="stable")
                    grams, bit = grams[order], bit[order]
                    first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
                    bits = np.bitwise_or.reduceat(np.uint64(1) << bit.astype(np.uint64), first)
                    n = np.diff(np.concatenate((first, [len(grams)])))
                    yield pa.RecordBatch.from_arrays([pa.array(grams[first].view(np.int64)), pa.array(n, pa.int64()), pa.array(bits.view(np.int64))], ["gram", "n", "bits"])

    rows = texts.select("text").mapInArrow(count, "gram long, n long, bits long")
    return rows.groupBy("gram").agg(F.sum("n").alias("n"), F.bit_or("bits").alias("bits"))


def seeds(grams: DataFrame, counts: DataFrame) -> DataFrame:
    """gram, key, place, rare of the n-grams that join texts to items; rare ones do it alone."""
    # surroundings in four steps, so that a copy or two more make an n-gram no less rare
    around = F.bit_count("bits")
    step = F.when(around <= 2, 0).when(around <= 8, 1).when(around < COMMON, 2).otherwise(3)
    known = grams.join(counts, "gram").withColumn("step", step)
    order = Window.partitionBy("key").orderBy("step", F.xxhash64("gram"), "place")
    most = F.greatest(F.lit(2), F.ceil(F.count(F.lit(1)).over(Window.partitionBy("key")) / RARE))
    ranked = known.withColumn("rare", F.col("short") | (F.row_number().over(order) <= most))
    return written(ranked.where(F.col("rare") | (F.col("step") < 3)).select("gram", "key", "place", "rare"), "seeds")


def align(item: np.ndarray, passages: np.ndarray) -> np.ndarray:
    """Best Smith-Waterman score of ``item`` against each row of ``passages`` (0: no word)."""
    width = passages.shape[1]
    slope = np.arange(1, width + 1) * -GAP
    h = np.zeros((len(passages), width + 1), np.int32)
    best = np.zeros(len(passages), np.int32)
    for word in item:
        score = np.where(passages == word, MATCH, MISMATCH)
        row = np.maximum(h[:, :-1] + score, h[:, 1:] + GAP)
        np.maximum(row, 0, out=row)
        # a gap in the item: the best of what lies to the left, less its distance
        row = np.maximum.accumulate(row + slope, axis=1) - slope
        h[:, 1:] = row
        np.maximum(best, row.max(1), out=best)
    return best


def needed(words: int) -> int:
    """The least score that counts as contamination by an item of so many words."""
    return MATCH * words if words < NGRAM else int(np.ceil(MATCH * min(SHARE * words, ENOUGH)))


def passages(hits: list[tuple[int, bool]], size: int) -> list[tuple[int, int]]:
    """(start, end) in words of the stretches of a text to align with an item of ``size`` words.

    hits: (text word - item word, whether the seed is rare). Hits of nearly one diagonal
    join; those with a rare seed, or with two hits, are passages.
    """
    slack = size // 4 + 4
    out: list[list] = []
    for diagonal, rare in sorted(hits):
        if out and diagonal - out[-1][2] <= 2 * slack:
            out[-1][1] = max(out[-1][1], diagonal + size + slack)
            out[-1][2:] = [diagonal, out[-1][3] or rare, out[-1][4] + 1]
        else:
            out.append([diagonal - slack, diagonal + size + slack, diagonal, rare, 1])
    return [(s, e) for s, e, _, rare, n in out if rare or n > 1]


def best_passages(asked: list[tuple[int, bytes, int, list[tuple[int, bool]]]], hashes: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(place in ``asked``, score, words, start, end) of those that reach their item's needed score.

    asked: (text, item's word hashes, item's key, hits). Passages of one item are aligned together.
    """
    by_item: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    own: dict[int, np.ndarray] = {}
    for k, (t, cell, key, hits) in enumerate(asked):
        if key not in own:
            own[key] = np.frombuffer(cell, np.uint64)
        by_item[key] += [(k, t, max(0, s), min(int(at[t + 1] - at[t]), e)) for s, e in passages(hits, len(own[key]))]
    best: dict[int, tuple[int, int, int, int]] = {}
    for key, places in by_item.items():
        least = needed(len(own[key]))
        for a in range(0, len(places), 256):
            some = places[a : a + 256]
            rows = np.zeros((len(some), max(1, max(e - s for _, _, s, e in some))), np.uint64)
            for r, (_, t, s, e) in enumerate(some):
                rows[r, : e - s] = hashes[at[t] + s : at[t] + e]
            for (k, _, s, e), score in zip(some, align(own[key], rows).tolist(), strict=True):
                if score >= least and score > best.get(k, (0,))[0]:
                    best[k] = (score, len(own[key]), s, e)
    return [(k, *v) for k, v in sorted(best.items())]


def _keyed(docs: DataFrame) -> list[Column]:
    return [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), F.col("text")).alias("t2")]


def joined(texts: DataFrame, benchmark: DataFrame) -> DataFrame | None:
    """t1, t2, items (item_id, key, hashes, hits) of the texts that meet items by seeds, written; None without items."""
    items = benchmark_items(benchmark)
    short = [r["words"] for r in items.where(F.col("words") < NGRAM).select("words").distinct().collect()]
    grams = item_grams(items)
    distinct = written(grams.select("gram").distinct(), "grams")
    if distinct.isEmpty():
        return None
    known = texts.sparkSession.sparkContext.broadcast(Filter.of(distinct))
    counts = written(gram_counts(texts, _Shared(known), short).join(distinct, "gram", "left_semi"), "gram-counts")
    sown = seeds(grams, counts)
    if sown.isEmpty():
        return None
    wanted = texts.sparkSession.sparkContext.broadcast(Filter.of(sown.select("gram").distinct()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                text, word, gram, _ = text_hits(*_words.words(texts_of(part)), wanted.value, short)
                if len(text):
                    at = pa.array(text)
                    yield pa.RecordBatch.from_arrays([part.column("t1").take(at), part.column("t2").take(at), pa.array(gram.view(np.int64)), pa.array(word, pa.int32())], [*_KEY, "gram", "word"])

    hits = texts.select(*_KEY, "text").mapInArrow(scan, "t1 long, t2 long, gram long, word int").join(sown, "gram")
    hits = hits.groupBy(*_KEY, "key").agg(F.collect_set(F.struct((F.col("word") - F.col("place")).alias("diagonal"), "rare")).alias("hits"))
    hits = hits.where((F.size("hits") > 1) | F.exists("hits", lambda h: h["rare"]))
    full = hits.join(items.select("key", "item_id", "hashes"), "key")
    return written(full.groupBy(*_KEY).agg(F.collect_list(F.struct("item_id", "key", "hashes", "hits")).alias("items")), "met")


class _Shared:
    """A broadcast filter that is opened on the worker."""

    def __init__(self, shared):
        self.shared = shared

    def among(self, grams: np.ndarray) -> np.ndarray:
        return self.shared.value.among(grams)


def _near(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """A semi or anti join by text; ``keys`` is written, and broadcast where its rows are few."""
    small = keys.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(keys) if small else keys, _KEY, how)


def aligned(rows: DataFrame, met: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, item_id, score, share, start_word, end_word for the rows and items that reach the needed score."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([f"{c} {kinds[c]}" for c in keep] + ["item_id long", "score int", "share double", "start_word int", "end_word int"])
    names = [*keep, "item_id", "score", "share", "start_word", "end_word"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                asked = [(t, i["hashes"], i["key"], [(h["diagonal"], h["rare"]) for h in i["hits"]]) for t, items in enumerate(part.column("items").to_pylist()) for i in items]
                ids = [i for items in part.column("items").to_pylist() for i in (x["item_id"] for x in items)]
                got = best_passages(asked, *_words.words(texts_of(part)))
                if got:
                    k, score, size, s, e = zip(*got, strict=True)
                    text = pa.array([asked[x][0] for x in k])
                    columns = [*(part.column(c).take(text) for c in keep), pa.array([ids[x] for x in k], pa.int64()), pa.array(score, pa.int32()), pa.array(np.array(score) / (MATCH * np.array(size)), pa.float64()), pa.array(s, pa.int32()), pa.array(e, pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, names)

    few = _near(rows, met.select(*_KEY), "left_semi")
    return few.join(met, _KEY).select(*keep, "text", "items").mapInArrow(scan, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, share, start_word, end_word of each contaminated text and item."""
    texts = docs.where(F.col("text") != "").select(F.col("doc_id").cast("long").alias("doc_id"), "text", *_keyed(docs))
    met = joined(texts, benchmark)
    if met is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score int, share double, start_word int, end_word int")
    return aligned(texts, met, ["doc_id"])


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without contaminated ones; a text is aligned once, however many rows have it."""
    texts = docs.where(F.col("text") != "").select("text", *_keyed(docs))
    met = joined(texts, benchmark)
    if met is None:
        return docs
    once = written(_near(texts, met.select(*_KEY), "left_semi").dropDuplicates(_KEY), "met-texts")
    bad = written(aligned(once, met, _KEY).select(*_KEY).distinct().toDF("_t1", "_t2"), "contaminated")
    small = bad.count() <= BROADCAST_ROWS
    first, second = _keyed(docs)
    bad = F.broadcast(bad) if small else bad
    return docs.join(bad, (first == bad["_t1"]) & (second == bad["_t2"]), "left_anti")
