"""Word and word n-gram hashes of whole Arrow text batches, without a Python loop over words.

A word is a maximal run of ASCII letters and digits and of non-ASCII characters of
the lower-cased text. Each gets a 64-bit polynomial hash; n-grams combine the hashes
of consecutive words of one text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from strandloom.llm._shared import raw

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_Q = 0xD6E8FEB86659FD93
_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_P, _P_INV)):
            t = np.full(n, base, np.uint64)
            t[0] = 1
            _powers[k] = np.multiply.accumulate(t)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, offsets): the words of text k are hashes[offsets[k]:offsets[k + 1]]."""
    return words_at(texts)[:2]


def words_at(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As words(), with the byte offsets of each word's start and end in its lower-cased text."""
    body, at = raw(pc.utf8_lower(texts.cast(pa.large_string())))
    n = len(body)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64), none, none
    is_word = _WORD[body]
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    start = is_word.copy()
    start[1:] &= ~is_word[:-1] | cut[1:n]
    end = is_word.copy()
    end[:-1] &= ~is_word[1:] | cut[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    up, down = _power(n)
    c = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[body] * up, out=c[1:])
    hashes = mix((c[e] - c[s]) * down[s] + (e - s).astype(np.uint64))
    owner = np.searchsorted(s, at).astype(np.int64)
    base = np.repeat(at[:-1], np.diff(owner))
    return hashes, owner, s - base, e - base


def ngrams(hashes: np.ndarray, offsets: np.ndarray, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram hashes, offsets). short: a text of 1 to n - 1 words has them all as its one n-gram."""
    total = len(hashes)
    sizes = np.diff(offsets)
    counts = np.maximum(sizes - n + 1, 0)
    out_at = np.zeros(len(offsets), np.int64)
    if not short:
        np.cumsum(counts, out=out_at[1:])
    else:
        np.cumsum(np.where((counts == 0) & (sizes > 0), 1, counts), out=out_at[1:])
    if total >= n:
        m = total - n + 1
        g = np.zeros(m, np.uint64)
        factor = 1
        for j in range(n):
            g += hashes[j : j + m] * np.uint64(factor)
            factor = factor * _Q % (1 << 64)
        g = mix(g)
    else:
        g = np.zeros(0, np.uint64)
    first = np.repeat(offsets[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    full = g[np.arange(len(first)) + first] if len(first) else np.zeros(0, np.uint64)
    if not short:
        return full, out_at
    out = np.zeros(int(out_at[-1]), np.uint64)
    tiny = np.flatnonzero((counts == 0) & (sizes > 0))
    keep = np.ones(len(out), bool)
    keep[out_at[tiny]] = False
    out[keep] = full
    for k in tiny:
        h, factor = 0, 1
        for w in hashes[offsets[k] : offsets[k + 1]].tolist():
            h, factor = (h + w * factor) % (1 << 64), factor * _Q % (1 << 64)
        out[out_at[k]] = mix(np.array([(h + int(sizes[k])) % (1 << 64)], np.uint64))[0]
    return out, out_at
