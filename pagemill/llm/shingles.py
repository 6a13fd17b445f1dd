"""Sets of word shingles as sorted 64-bit numbers."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

from . import wordhash

WORDS = 5


def shingle_sets(texts: Iterable[str | None], n_words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(all sets one after the other, each sorted and distinct; the size of each).

    A text with fewer words has its whole sequence as one shingle; one without words has the empty set.
    """
    h, counts = wordhash.words(texts)
    ends = np.cumsum(counts)
    starts = ends - counts
    rolled = np.zeros(len(h), np.uint64)
    factors = wordhash.mix(np.arange(n_words, dtype=np.uint64) + np.uint64(77)) | np.uint64(1)
    for k in range(n_words):
        rolled[: len(h) - k] += h[k:] * factors[k]
    rolled = wordhash.mix(rolled)
    sets, sizes = [], []
    for s, e, n in zip(starts.tolist(), ends.tolist(), counts.tolist(), strict=True):
        if n >= n_words:
            x = rolled[s : e - n_words + 1].copy()
            x.sort()
            if len(x) > 1:
                x = x[np.concatenate([[True], x[1:] != x[:-1]])]
        elif n:
            x = wordhash.mix(np.array([(h[s:e] * factors[:n]).sum() + np.uint64(n)], np.uint64))
        else:
            x = h[:0]
        sets.append(x)
        sizes.append(len(x))
    return np.concatenate(sets or [np.zeros(0, np.uint64)]), np.asarray(sizes, np.int64)


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted distinct arrays."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large) or not len(small):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)
