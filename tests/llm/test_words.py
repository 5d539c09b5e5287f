import re

import numpy as np
import pyarrow as pa

from strandloom.llm import _words

TEXTS = ["The cat, the CAT.", "", "a", "é à un deux", "x1 y2 x1", "--", "one two three four five six"]


def _tokens(t):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower())


def test_words_are_told_apart_as_their_texts():
    hashes, at = _words.words(pa.array(TEXTS, pa.large_string()))
    known = {}
    for k, t in enumerate(TEXTS):
        own = hashes[at[k] : at[k + 1]].tolist()
        assert len(own) == len(_tokens(t))
        for h, w in zip(own, _tokens(t), strict=True):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


def test_slices_of_arrays_give_the_same_words():
    whole = pa.array(TEXTS, pa.large_string())
    a, at = _words.words(whole)
    b, bt = _words.words(whole.slice(3, 2))
    assert (a[at[3] : at[5]] == b).all() and bt[-1] == len(b)


def test_ngrams_stay_within_their_text():
    hashes, at = _words.words(pa.array(TEXTS, pa.large_string()))
    for n in (1, 2, 3, 5):
        grams, gram_at = _words.ngrams(hashes, at, n)
        short, short_at = _words.ngrams(hashes, at, n, short=True)
        for k, t in enumerate(TEXTS):
            w = _tokens(t)
            assert gram_at[k + 1] - gram_at[k] == max(0, len(w) - n + 1)
            assert short_at[k + 1] - short_at[k] == (max(1, len(w) - n + 1) if w else 0)
    twice, at2 = _words.ngrams(*_words.words(pa.array(["a b c", "x a b c"], pa.large_string())), 3)
    assert twice[0] == twice[2] and len(np.unique(twice)) == 2
