"""Words of many texts as 64-bit numbers, by whole arrays instead of word by word.

A word is a run of bytes other than space and 0x09 to 0x0D, with A-Z lower-cased. Its number is a multilinear hash:
the sum over its bytes of a random value of the byte times a random value of the place, mixed with its length. Equal
words have equal numbers on every machine; two different ones share a number with odds of about 2^-60.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np

_U = np.uint64
#: A text longer than this is taken in parts, cut at white space; bounds the arrays.
PART = 1 << 20
_GAP = re.compile(rb"[\x20\x09-\x0d]")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser known as splitmix64)."""
    x = x + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_FOLD = np.arange(256)
_FOLD[65:91] += 32
_BYTE = (mix(np.arange(256, dtype=_U) + _U(1 << 20)) | _U(1))[_FOLD]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_places = mix(np.arange(4096, dtype=_U) + _U(1 << 40)) | _U(1)


def _place(n: int) -> np.ndarray:
    global _places
    if len(_places) < n:
        _places = mix(np.arange(2 * n, dtype=_U) + _U(1 << 40)) | _U(1)
    return _places


def _hash(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and starts of the words of one buffer."""
    a = np.frombuffer(buffer, np.uint8)
    ink = ~_SPACE[a]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], ink, [False]]).view(np.int8)))
    starts, lengths = edge[::2], edge[1::2] - edge[::2]
    if not len(starts):
        return np.zeros(0, _U), starts
    first = np.cumsum(lengths) - lengths
    at = np.arange(lengths.sum()) - np.repeat(first, lengths)
    summed = np.add.reduceat(_BYTE[a[ink]] * _place(int(lengths.max()))[at], first)
    return mix(summed + lengths.astype(_U) * _U(0xD6E8FEB86659FD93)), starts


def _parts(text: bytes) -> Iterator[bytes]:
    at = 0
    while len(text) - at > PART and (m := _GAP.search(text, at + PART)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def words(texts: Iterable[str | bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all words in order, words of each text). Null is a text without words."""
    hashes, counts, held, size = [], [], [], 0

    def flush() -> None:
        nonlocal held, size
        if held:
            h, starts = _hash(b"\n".join(held))
            begins = np.cumsum([0] + [len(x) + 1 for x in held[:-1]])
            counts.append(np.diff(np.append(np.searchsorted(starts, begins), len(starts))))
            hashes.append(h)
            held, size = [], 0

    for text in texts:
        b = text.encode() if isinstance(text, str) else text or b""
        if len(b) > PART:
            flush()
            each = [_hash(p)[0] for p in _parts(b)]
            hashes += each
            counts.append(np.array([sum(map(len, each))]))
            continue
        held.append(b)
        size += len(b) + 1
        if size > PART:
            flush()
    flush()
    return np.concatenate(hashes or [np.zeros(0, _U)]), np.concatenate(counts or [np.zeros(0, np.int64)]).astype(np.int64)
