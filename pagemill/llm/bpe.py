"""Byte-level BPE of whole texts, piece by piece.

No pre-token runs from a non-space into a space, so a text falls into pieces (white space, then what follows it) that
encode alone as they do within the text; a special string has no white space and stays in one piece. So a text may be
cut wherever pieces end, and its parts may be encoded by whichever library is sure to be right for them.
"""

from __future__ import annotations

import base64
import functools
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import regex
import tiktoken
from tokenizers import Tokenizer

#: White space as Unicode has it; Python's own class also holds U+001C to U+001F.
SPACE = "\t-\r \x85\xa0  -     　"
PIECE = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: From here on the two libraries may follow different versions of Unicode, and the slower one decides.
PLAIN_BELOW = "԰"
#: Pieces whose counts a worker keeps at most; those longer than LONGEST_KEPT rarely come again and are not kept.
CACHE, LONGEST_KEPT = 500_000, 60
PRETOKEN = regex.compile(public_tokenizers.PATTERN)
_FAR = re.compile(f"[{PLAIN_BELOW}-\U0010ffff]")


class Encoder:
    """Ids as the library of the .json file gives them, without added special tokens."""

    def __init__(self, vocabulary: str = "byte_bpe_50k"):
        self.path = public_tokenizers.path(f"{vocabulary}.json")
        with open(self.path, encoding="utf-8") as f:
            special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        size = max(*ranks.values(), *special.values()) + 1
        #: by id: whether a token ends as a sentence does, and whether it begins with white space
        self.closing, self.spaced = np.zeros(size, bool), np.zeros(size, bool)
        for token, i in ranks.items():
            self.closing[i] = token.endswith((b".", b"!", b"?"))
            self.spaced[i] = token[:1].isspace()

    @functools.cached_property
    def exact(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    def _plain(self, text: str) -> np.ndarray:
        return self.fast.encode_to_numpy(text, allowed_special="all") if "<|" in text else self.fast.encode_to_numpy(text, disallowed_special=())

    def array(self, text: str) -> np.ndarray:
        """Ids of a text that ends where a piece does, as unsigned 32-bit numbers."""
        if not _FAR.search(text):
            return self._plain(text)
        out = []
        for far, pieces in itertools.groupby(PIECE.findall(text), lambda p: bool(_FAR.search(p))):
            part = "".join(pieces)
            out.append(np.array(self.exact.encode(part, add_special_tokens=False).ids, np.uint32) if far else self._plain(part))
        return np.concatenate(out)


class Counts:
    """Pieces to their number of tokens.

    A piece is cut into pre-tokens by the vocabulary's pattern. Those among ``whole``, which are proven to be one token,
    count one; only the others are merged. What a worker has met is kept, up to a bound.
    """

    def __init__(self, encoder: Encoder, whole: frozenset[str]):
        self.encoder, self.whole = encoder, whole
        self.values: dict[str, int] = {}

    def of(self, pieces: list[str]) -> list[int]:
        missing = set(pieces).difference(self.values)
        if not missing:
            return list(map(self.values.__getitem__, pieces))
        if len(self.values) + len(missing) > CACHE:
            self.values = {}
            missing = set(pieces)
        self._learn(missing)
        out = list(map(self.values.__getitem__, pieces))
        for p in missing:
            if len(p) > LONGEST_KEPT:
                del self.values[p]
        return out

    def _learn(self, missing: set[str]) -> None:
        unknown = missing - self.whole  # a piece that is one pre-token itself needs no cut
        self.values.update(dict.fromkeys(missing & self.whole, 1))
        plain = []
        for p in unknown:
            # these may be put together: they begin with white space and end without, and so keep apart
            if p[0] in " \n\t\r" and not p[-1].isspace() and "<|" not in p and not _FAR.search(p):
                plain.append(p)
            else:
                self.values[p] = len(self.encoder.array(p))
        if plain:
            parts = PRETOKEN.findall("".join(plain))
            merged = self.encoder.fast.encode_ordinary
            n = np.fromiter((1 if x in self.whole else len(merged(x)) for x in parts), np.int64, len(parts))
            ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
            wanted = np.cumsum(np.fromiter(map(len, plain), np.int64, len(plain)))
            cuts = np.searchsorted(ends, wanted)
            if cuts[-1] >= len(parts) or not np.array_equal(ends[cuts], wanted):
                raise ValueError("a pre-token runs across two pieces")
            self.values.update(zip(plain, np.diff(np.cumsum(n)[cuts], prepend=0).tolist(), strict=True))


@functools.cache
def encoder(vocabulary: str = "byte_bpe_50k") -> Encoder:
    return Encoder(vocabulary)


#: Characters of a text that are encoded at a time.
SLICE = 1 << 20
_SEAM = re.compile(f"[^{SPACE}](?=[{SPACE}])")


def slices(text: str) -> Iterator[str]:
    """A text in parts that end where pieces do."""
    at = 0
    while len(text) - at > SLICE and (m := _SEAM.search(text, at + SLICE)):
        yield text[at : m.end()]
        at = m.end()
    yield text[at:]


def prove_whole_tokens(vocabulary: str = "byte_bpe_50k") -> frozenset[str]:
    """Vocabulary strings that are one pre-token and that the library itself encodes, alone, as their one id.

    Offline, without any corpus. Strings that are not text, that are cut by pre-tokenization or that merges never
    reach are left out: they are merged like any other pre-token.
    """
    e = encoder(vocabulary).exact
    strings = {i: e.decode([i], skip_special_tokens=False) for i in e.get_vocab().values()}
    tried = {i: s for i, s in strings.items() if s and "\ufffd" not in s and PRETOKEN.fullmatch(s)}
    encoded = e.encode_batch(list(tried.values()), add_special_tokens=False)
    return frozenset(s for (i, s), got in zip(tried.items(), encoded, strict=True) if got.ids == [i])
