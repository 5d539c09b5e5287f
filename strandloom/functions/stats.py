"""Statistics of local alignment scores.

With Gumbel parameters lambda and K, a score S has the bit score (lambda S - ln K) / ln 2
and the E-value K m' n' exp(-lambda S), where m' and n' are the lengths of references
and reads less the expected length of a chance alignment. Without given parameters the
ungapped lambda is solved from the scores and letter frequencies and the gapped pair is
estimated once on the driver from seeded random alignments (a fixed number of them).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from strandloom.config import SearchConfig

_SIMULATED = 6000
_LENGTH = 200


def ungapped_lambda(freqs: dict[str, float], match: int, mismatch: int) -> float:
    """The positive root of sum p_i p_j exp(lambda s_ij) = 1."""
    same = sum(p * p for p in freqs.values())
    f = lambda x: same * math.exp(x * match) + (1 - same) * math.exp(x * mismatch) - 1
    low, high = 1e-6, 1.0
    while f(high) < 0:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return (low + high) / 2


def _random_scores(freqs: dict[str, float], config: SearchConfig, n: int, length: int, seed: int) -> np.ndarray:
    """Best local scores of n pairs of random sequences, all pairs side by side."""
    rng = np.random.default_rng(seed)
    p = np.array([freqs.get(c, 0.0) for c in "ACGT"])
    p = p / p.sum()
    a, b = (rng.choice(4, (n, length), p=p) for _ in range(2))
    h = np.zeros((n, length + 1), np.int32)
    e = np.full((n, length), -10_000, np.int32)
    best = np.zeros(n, np.int32)
    slope = np.arange(length, dtype=np.int32) * config.gap_ext
    match, mismatch = np.int32(config.match), np.int32(config.mismatch)
    for k in range(length):
        diagonal = h[:, :-1] + np.where(b == a[:, k : k + 1], match, mismatch)
        e = np.maximum(e - config.gap_ext, h[:, 1:] - config.gap_open)
        row = np.maximum(np.maximum(diagonal, e), 0)
        run = np.maximum.accumulate(row + slope, axis=1)[:, :-1] - config.gap_open - slope[:-1]
        row[:, 1:] = np.maximum(row[:, 1:], run)
        h[:, 1:] = row
        np.maximum(best, row.max(1), out=best)
    return best


def gumbel_parameters(freqs: dict[str, float], config: SearchConfig, seed: int = 7) -> tuple[float, float]:
    """(lambda, K) for gapped local alignment: the given pair, or an estimate by simulation.

    lambda is the likeliest one for the scores of random pairs and K follows from it and them.
    The sampling error of lambda is about a hundredth; give ``gumbel`` where exact parity is
    needed.
    """
    if config.gumbel:
        return config.gumbel
    top = ungapped_lambda(freqs, config.match, config.mismatch)
    parts = 8
    scores = np.concatenate([_random_scores(freqs, config, _SIMULATED // parts, _LENGTH, seed + k) for k in range(parts)]).astype(float)
    mean, low, high = float(scores.mean()), 1e-3, top
    # the likelihood's slope, mean - weighted mean - 1 / lambda, changes its sign once
    for _ in range(60):
        lam = (low + high) / 2
        weight = np.exp(-lam * (scores - scores.min()))
        low, high = (lam, high) if mean - float((scores * weight).sum() / weight.sum()) < 1 / lam else (low, lam)
    k = math.exp(-math.log(float(np.exp(-lam * scores).mean()))) / _LENGTH**2
    return lam, min(max(k, 1e-3), 1.0)


def entropy(freqs: dict[str, float]) -> float:
    """H in bits of the letter frequencies."""
    return -sum(p * math.log2(p) for p in freqs.values() if p > 0)


@dataclass(frozen=True)
class ScoreStats:
    """Statistics of one database for one set of reads."""

    lam: float
    k: float
    h: float
    full_ref: int
    full_read: int
    minimal_score: int


def score_stats(freqs: dict[str, float], ref_len: int, n_refs: int, read_len: int, n_reads: int, config: SearchConfig) -> ScoreStats:
    """Corrected lengths and the least score for the E-value asked for."""
    lam, k = gumbel_parameters(freqs, config)
    h, scale = entropy(freqs), config.score_split
    m, n = ref_len, read_len
    less = int(max(0.0, math.log(max(k * m * n / scale, 1.0)) / h)) if m and n and h else 0
    if m > less * n_refs:
        m -= less * n_refs
    n = max(1, n - less * n_reads // scale)
    ratio = config.evalue / (k * max(m, 1) * n / scale) if config.evalue > 0 else 0.0
    least = int(math.log(ratio) / -lam) if ratio > 0 else 0
    return ScoreStats(lam, k, h, m, n, max(0, least))


def bit_score(score: Column, lam: float, k: float) -> Column:
    """Whole bits, rounded down."""
    return F.floor((score * F.lit(lam) - F.lit(math.log(k))) / F.lit(math.log(2.0))).cast("int")


def e_value(score: Column, lam: float, k: float, full_ref: int, full_read: int) -> Column:
    return F.lit(k * full_ref * full_read) * F.exp(score * F.lit(-lam))


def rounded_ratio(x: Column) -> Column:
    """A share rounded to thousandths, the one form used everywhere."""
    return F.floor(x * 1000 + 0.5) / 1000
