"""Language identification by rank-order n-gram profiles.

A profile is the list of a language's most frequent 1- to 3-grams of letters, words
bounded by a mark. A document's own list is compared with each: every n-gram adds how
far out of place it is, or the list's length where the profile lacks it. The least
sum wins.

Counts for the profiles cover all training documents and all of their text: each task
sums its own counts, Spark sums those. Profiles have a fixed number of rows a language.

Defined cases: null texts and texts without a letter are ``und`` with score 0; so is
every text when nothing was learned; ties go to the smaller language name, ties among
n-grams to the smaller one; more than LANGUAGES_MOST languages raise; rows of null doc_id are predicted but not learned from;
texts of any length are read whole; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm._shared import fold, slices

PROFILE = 400
LANGUAGES_MOST = 5000
_EDGE = 1  # the mark at word edges; 0 stands for no letter
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text numbers, n-gram codes, alphabet) of all 1- to 3-grams.

    A code has base len(alphabet) digits, each the place of a letter in the sorted
    alphabet of these texts, so codes have the order of their letters everywhere.
    """
    low = [t.lower() if t else "" for t in texts]
    points = np.frombuffer("".join(f"\n{t}\n" for t in low).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[points]
    points = np.where(letter, points, _EDGE)
    # every text starts and ends with a boundary; runs of non-letters become one mark
    sizes = np.fromiter((len(t) + 2 for t in low), np.int64, len(low))
    owner = np.repeat(np.arange(len(low)), sizes)
    first = np.zeros(len(points), bool)
    first[np.cumsum(sizes) - sizes] = True
    keep = letter | first
    keep[1:] |= letter[:-1]
    points, owner = points[keep], owner[keep]
    used = np.unique(points)
    alphabet = np.concatenate(([0], used if len(used) and used[0] == _EDGE else np.concatenate(([_EDGE], used)))).astype(np.int64)
    size = len(alphabet)
    digit = np.searchsorted(alphabet, points).astype(np.int64)
    one = digit > 1
    two = (owner[1:] == owner[:-1]) & (one[1:] | one[:-1])
    three = (owner[2:] == owner[:-2]) & one[1:-1]
    codes = np.concatenate((digit[one], (digit[:-1] * size + digit[1:])[two], ((digit[:-2] * size + digit[1:-1]) * size + digit[2:])[three]))
    return np.concatenate((owner[one], owner[1:][two], owner[2:][three])), codes, alphabet


def spelled(codes: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """Codes of one alphabet as codes of all code points, 21 bits a letter."""
    n = len(alphabet)
    return alphabet[codes // (n * n)] << 42 | alphabet[codes // n % n] << 21 | alphabet[codes % n]


def ranked(owner: np.ndarray, codes: np.ndarray, alphabet: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text numbers, ranks from 0, codes) of each text's ``most`` most frequent n-grams."""
    space = len(alphabet) ** 3
    key = np.sort(owner * space + codes)
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate((start, [len(key)])))
    key = key[start]
    own, code = key // space, key % space
    top = int(count.max(initial=0)) + 1
    if (int(own[-1]) + 1 if len(own) else 1) * top * space < 1 << 62:
        joint = np.sort((own * top + (top - 1 - count)) * space + code)
        own, code = joint // (top * space), joint % space
    else:
        order = np.lexsort((code, -count, own))
        own, code = own[order], code[order]
    first = np.searchsorted(own, own)
    rank = np.arange(len(own)) - first
    ok = rank < most
    return own[ok], rank[ok], code[ok]


class Profiles:
    """Rank tables of all languages. rows: (language, n-gram code, rank from 0)."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int = PROFILE):
        self.size = size
        self.names = sorted({r[0] for r in rows})
        self.codes = np.unique(np.array([r[1] for r in rows], np.int64))
        self.table = np.full((len(self.codes) + 1, len(self.names)), size, np.int32)
        place = {n: k for k, n in enumerate(self.names)}
        for name, code, rank in rows:
            self.table[np.searchsorted(self.codes, code), place[name]] = rank

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        owner, codes, alphabet = grams(texts)
        if not self.names or not len(codes):
            return names, scores
        own, rank, code = ranked(owner, codes, alphabet, self.size)
        full = spelled(code, alphabet)
        at = np.searchsorted(self.codes, full)
        at[at == len(self.codes)] = 0
        at = np.where(self.codes[at] == full, at, len(self.codes))
        where = self.table[at]
        far = np.where(where < self.size, np.abs(where - rank[:, None]), self.size)
        start = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        total = np.add.reduceat(far, start, axis=0)
        n = np.diff(np.concatenate((start, [len(own)])))
        best = total.argmin(1)
        score = 1 - total[np.arange(len(best)), best] / (n * self.size)
        for k, b, s in zip(own[start].tolist(), best.tolist(), score.tolist(), strict=True):
            names[k], scores[k] = self.names[b], s
        return names, scores


def learn(training: DataFrame, size: int = PROFILE) -> Profiles:
    """Profiles of the languages of ``training`` (text, lang; neither null), counted over all of it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        kept = 0

        def merged(own: list) -> tuple[np.ndarray, np.ndarray]:
            codes, counts = np.concatenate([c for c, _ in own]), np.concatenate([n for _, n in own])
            unique, place = np.unique(codes, return_inverse=True)
            return unique, np.bincount(place, counts, len(unique)).astype(np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            for name, own in held.items():
                codes, counts = merged(own)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], ["lang", "gram", "n"])

        for batch in batches:
            for part in slices(batch, "text"):
                langs = np.array(part.column("lang").to_pylist(), object)
                owner, codes, alphabet = grams(part.column("text").to_pylist())
                names, place = np.unique(langs.astype(str), return_inverse=True)
                space = len(alphabet) ** 3
                joint = place[owner] * space + codes
                if space * len(names) <= 4_000_000:
                    sums = np.bincount(joint, minlength=space * len(names))
                    joint = np.flatnonzero(sums)
                    sums = sums[joint]
                else:
                    joint, sums = np.unique(joint, return_counts=True)
                for k, name in enumerate(names.tolist()):
                    s, e = np.searchsorted(joint, (k * space, (k + 1) * space))
                    own = held.setdefault(name, [])
                    own.append((spelled(joint[s:e] % space, alphabet), sums[s:e]))
                    kept += int(e - s)
                    if len(own) >= 32:
                        kept -= sum(len(c) for c, _ in own)
                        own[:] = [merged(own)]
                        kept += len(own[0][0])
                if kept > 2_000_000:
                    yield from flush()
                    held, kept = {}, 0
        yield from flush()

    counts = training.select("text", "lang").mapInArrow(count, "lang string, gram long, n long")
    sums = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    top = sums.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < size).select("lang", "gram", "rank")
    rows = top.limit(LANGUAGES_MOST * size + 1).collect()
    if len(rows) > LANGUAGES_MOST * size:
        raise ValueError(f"more than {LANGUAGES_MOST} languages")
    return Profiles([tuple(r) for r in rows], size)


def predict(docs: DataFrame, profiles: Profiles, keep: list[str]) -> DataFrame:
    """The ``keep`` columns of ``docs`` with lang_pred and score; ``docs`` has them and text."""
    from pyspark.sql import types as T

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                names, scores = own.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    return docs.select(*keep, "text").mapInArrow(run, schema)


def identify(docs: DataFrame, size: int = PROFILE, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each document; learned from the other folds."""
    mine = docs.select("doc_id", "text", "lang", F.coalesce(fold("doc_id", folds) == held, F.lit(False)).alias("held_out"))
    training = mine.where(~F.col("held_out") & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return predict(mine, learn(training, size), ["doc_id", "held_out"])
