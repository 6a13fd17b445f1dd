"""Order-preserving packing of documents into fixed windows by dynamic programming.

Documents, each ended by one token, form a stream in the order they are stored. Windows are cut at ends of documents
or sentences. f(j), the least cost of all up to boundary j, is pen(j) + the least of two: window - p(j) + min of
f(i) + p(i) over the boundaries i within one window of j; and f(i) + SHORT over those i from which to j it is a power of
two, as such a sequence needs no padding. As the range of the first only moves on, a monotone queue yields each
minimum in constant time. Where a sentence is longer than a window, boundaries are put inside it at a price.
"""

from __future__ import annotations

import itertools
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from ._common import tidied, with_code

WINDOW = 2048
END_ID = 1
#: Cost, in tokens of padding, of a cut at the end of a document, of a sentence, and inside a sentence.
DOCUMENT_CUT, SENTENCE_CUT, HARD_CUT = 0.0, 4.0, 16.0
#: Cost of a sequence that is a power of two shorter than the window: more sequences for the same tokens.
SHORT = 32.0
#: Steps in a window between the boundaries inside a sentence that is longer than it.
STEPS = 16
#: Tokens after which the windows of a task so far are settled, but for the last few; bounds memory.
SEGMENT = 500_000


def tokens_of(text: str, encoder: bpe.Encoder) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a text or a slice of one, and the positions after its sentences: where white space or the end follows."""
    flat = encoder.array(text) if text else np.zeros(0, np.uint32)
    closing = encoder.closing[flat]
    closing[:-1] &= encoder.spaced[flat[1:]]
    return flat, np.flatnonzero(closing) + 1


def boundaries(n: int, ends: np.ndarray, stops: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a stream of ``n`` may be cut, ascending from 0 to its end, and what each cut costs."""
    at = np.unique(np.concatenate([[0], stops, ends, [n]]).astype(np.int64))
    step = max(1, window // STEPS)
    gaps = np.flatnonzero(np.diff(at) > window)
    hard = np.concatenate([np.arange(at[g] + step, at[g + 1], step) for g in gaps] or [np.zeros(0, np.int64)])
    cost = np.full(len(at), SENTENCE_CUT)
    cost[np.isin(at, ends) | (at == 0)] = DOCUMENT_CUT
    both = np.concatenate([at, hard])
    order = np.argsort(both, kind="stable")
    return both[order], np.concatenate([cost, np.full(len(hard), HARD_CUT)])[order]


def best_cuts(at: np.ndarray, cost: np.ndarray, window: int) -> list[int]:
    """Indices of the boundaries that the cheapest windows end at."""
    p, pen, n = at.tolist(), cost.tolist(), len(at)
    late, early = [], []  # pairs of boundaries that are a power of two apart
    for k in range((window - 1).bit_length()):
        i = np.minimum(np.searchsorted(at, at - (1 << k)), n - 1)
        j = np.flatnonzero(at[i] == at - (1 << k))
        late.append(j)
        early.append(i[j])
    late, early = np.concatenate([*late, [n]]), np.concatenate([*early, [n]])  # the last is never reached
    order = np.argsort(late, kind="stable")
    late, early = late[order].tolist(), early[order].tolist()
    f, back, g = [0.0] * n, [0] * n, [0.0] * n
    queue: deque[int] = deque()
    c, short = 0, late[0]
    for j in range(1, n):
        i, here = j - 1, p[j]
        g[i] = mine = f[i] + p[i]
        while queue and g[queue[-1]] >= mine:
            queue.pop()
        queue.append(i)
        while here - p[queue[0]] > window:
            queue.popleft()
        whence = queue[0]
        best = g[whence] + window - here
        while short == j:
            i = early[c]
            if f[i] + SHORT < best:
                best, whence = f[i] + SHORT, i
            c += 1
            short = late[c]
        f[j], back[j] = best + pen[j], whence
    cuts, j = [], n - 1
    while j > 0:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


def windows(at: np.ndarray, cost: np.ndarray, window: int = WINDOW) -> list[int]:
    """Where the windows end. A last window far from full is cut into powers of two if that costs less than its padding."""
    ends = [int(at[j]) for j in best_cuts(at, cost, window)]
    if ends:
        start = ends[-2] if len(ends) > 1 else 0
        left = ends[-1] - start
        bits = [1 << k for k in range(left.bit_length() - 1, -1, -1) if left >> k & 1]
        if left < window and window - left > (HARD_CUT + SHORT) * (len(bits) - 1):
            ends[-1:] = list(itertools.accumulate(bits, initial=start))[1:]
    return ends


class Packer:
    """Takes the tokens of documents in order and gives pieces of windows, holding little more than a segment."""

    def __init__(self, window: int, first_sequence: int):
        self.window, self.sequence = window, first_sequence
        self.parts: list[np.ndarray] = []  # the stream that is not settled yet
        self.n = 0
        self.docs: list[list] = []  # documents that reach into it: id, tokens before it, where its tokens here end, tokens
        self.stops: list[np.ndarray] = []
        self.ends: list[int] = []

    def add(self, ids: np.ndarray, stops: np.ndarray) -> None:
        self.stops.append(stops + self.n)
        self.parts.append(ids)
        self.n += len(ids)

    def begin(self, doc_id: object, tokens: int) -> None:
        self.docs.append([doc_id, 0, self.n, tokens])

    def reach(self) -> None:
        """The last document reaches up to here."""
        self.docs[-1][2] = self.n

    def end(self) -> None:
        self.reach()
        self.ends.append(self.n)

    def settle(self, final: bool) -> dict[str, object]:
        """Pieces of the windows so far; all of them if this is the end, else without the last few, which stay open."""
        stream = np.concatenate(self.parts)
        found = np.asarray(windows(*boundaries(self.n, np.asarray(self.ends, np.int64), np.concatenate(self.stops), self.window), self.window), np.int64)
        if not final:
            found = found[found <= self.n - 4 * self.window]
        upto = int(found[-1])
        reaches = np.array([d[2] for d in self.docs])
        cuts = np.union1d(found, reaches[reaches < upto])
        starts = np.concatenate([[0], cuts[:-1]])
        which = np.searchsorted(reaches, starts, side="right")
        firsts = np.concatenate([[0], reaches[:-1]])  # where each document's tokens here begin
        number = np.searchsorted(found, starts, side="right")
        raw = memoryview(np.ascontiguousarray(stream, "<u4")).cast("B")
        out = {
            "which": which,
            "ids": [d[0] for d in self.docs],
            "start": starts - firsts[which] + np.array([d[1] for d in self.docs])[which],
            "length": cuts - starts,
            "ids_crc32": [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), cuts.tolist(), strict=True)],
            "doc_tokens": np.array([d[3] for d in self.docs])[which],
            "sequence_id": self.sequence + number,
            "offset": starts - np.concatenate([[0], found])[number],
            "stream": stream[:upto],
            "cuts": cuts,
        }
        self.sequence += len(found)
        done = int(np.searchsorted(reaches, upto, side="right"))
        self.docs = [[d[0], d[1] + max(0, upto - int(a)), d[2] - upto, d[3]] for d, a in zip(self.docs[done:], firsts[done:], strict=True)]
        self.parts, self.n = [stream[upto:].copy()], self.n - upto
        stops = np.concatenate(self.stops)
        self.stops, self.ends = [stops[stops > upto] - upto], [e - upto for e in self.ends if e > upto]
        return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_ids: bool = False, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and the ids).

    Documents stay in the order of their partition, which is not shuffled; each task packs what it reads, in segments
    of about ``SEGMENT`` tokens, whatever the length of a document. Null or empty text is its end token alone. Rows
    that repeat are packed each. Other columns are not read; no row gives no piece.
    """
    with_code(docs.sparkSession)
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("t"))
    kind = rows.schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, {', '.join(f'{n} long' for n in names)}" + (", ids array<int>" if with_ids else "")
    end, no_stop = np.array([END_ID], np.uint32), np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.encoder(vocabulary)
        packer = Packer(window, TaskContext.get().partitionId() << 36)
        id_type, enough = None, max(SEGMENT, 16 * window)

        def settled(final: bool = False) -> pa.RecordBatch:
            out = packer.settle(final)
            cols = [pa.array(out["ids"], id_type).take(pa.array(out["which"]))] + [pa.array(out[c], pa.int64()) for c in names]
            if with_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], out["cuts"]]), pa.int32()), pa.array(out["stream"].view(np.int32))))
            return pa.record_batch(cols, names=[id_col, *names, *["ids"] * with_ids])

        for batch in batches:
            id_type = batch.schema.field(0).type
            for key, text in (row for i in range(0, batch.num_rows, 256) for row in zip(*(c.to_pylist() for c in batch.slice(i, 256).columns), strict=True)):
                if text and len(text) > bpe.SLICE:  # its tokens are counted first, then encoded once more and packed slice by slice
                    packer.begin(key, 1 + sum(len(encoder.array(part)) for part in bpe.slices(text)))
                    for part in bpe.slices(text):
                        packer.add(*tokens_of(part, encoder))
                        packer.reach()
                        if packer.n >= enough:
                            yield settled()
                else:
                    flat, stops = tokens_of(text or "", encoder)
                    packer.begin(key, len(flat) + 1)
                    packer.add(flat, stops)
                packer.add(end, no_stop)
                packer.end()
                if packer.n >= enough:
                    yield settled()
        if packer.n:
            yield settled(final=True)

    return rows.mapInArrow(tidied(run), schema)
