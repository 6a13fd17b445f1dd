"""Folds: the rows of a key pass by in order and a small state decides on each, one after the other.

For what no window can express, as a rejected row must not become anybody's predecessor. Keys are the unit of parallel
work; rows stream by in sorted partitions, so nothing of a key is gathered but what its state holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..shipping import with_code

#: Rows that are given out together.
OUT = 10_000


class Machine:
    """The state of one key. ``row`` gets the values of one row and ``end`` none; both return rows to give out."""

    def row(self, *values) -> Iterable[tuple]:
        return ()

    def end(self) -> Iterable[tuple]:
        return ()


def fold(rows: DataFrame, key: list[str], order: list[str | Column], values: list[str], machine: Callable[[], Machine], schema: str) -> DataFrame:
    """One ``machine`` for each key; the key's columns come first in each row that is given out, then what the machine
    returns, as ``schema`` says. Keys that are null are a key as well."""
    with_code(rows.sparkSession)
    kinds = dict(rows.dtypes)
    dealt = rows.repartition(*key).sortWithinPartitions(*key, *order).select(*key, *values)
    whole = ", ".join([*(f"`{k}` {kinds[k]}" for k in key), schema])
    n, target = len(key), to_arrow_schema(StructType.fromDDL(whole))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        out: list[tuple] = []

        def given() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [()] * len(target)
            batch = pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, target, strict=True)], schema=target)
            out.clear()
            return batch

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or row[:n] != now:
                    if state is not None:
                        out += [(*now, *x) for x in state.end()]
                    now, state = row[:n], machine()
                out += [(*now, *x) for x in state.row(*row[n:])]
                if len(out) >= OUT:
                    yield given()
        if state is not None:
            out += [(*now, *x) for x in state.end()]
        if out:
            yield given()

    return dealt.mapInArrow(run, whole)


class Expected(Machine):
    """Numbers of one chapter: the expected one, or one at most ``skip`` above it, or 1 as a restart."""

    def __init__(self, skip: int):
        self.skip, self.want = skip, 1
        self.accepted: list[int] = []
        self.gaps: list[int] = []
        self.rejected: list[int] = []

    def row(self, k: int) -> Iterable[tuple]:
        if self.want <= k <= self.want + self.skip or k == 1:
            self.gaps += range(self.want, k)
            self.accepted.append(k)
            self.want = k + 1
        else:
            self.rejected.append(k)
        return ()

    def end(self) -> Iterable[tuple]:
        return [(self.accepted, self.gaps, self.rejected)]


class Plain(Machine):
    """Numbers without a chapter inside sections, which headings open and stops close."""

    def __init__(self, skip: int):
        self.skip, self.want, self.inside, self.opened = skip, 1, False, False
        self.accepted: list[int] = []

    def row(self, kind: str | None, k: int | None) -> Iterable[tuple]:
        if kind in ("heading", "stop"):
            self.inside = self.opened = kind == "heading"
        elif self.inside and k is not None and (self.want <= k <= self.want + self.skip or k == 1 and self.opened):
            self.accepted.append(k)
            self.want, self.opened = k + 1, False
        return ()

    def end(self) -> Iterable[tuple]:
        return [(self.accepted,)]


class Greater(Machine):
    """For rows from the last to the first: the nearest later value that is greater, by a stack of those not hidden yet."""

    def __init__(self):
        self.stack: list = []

    def row(self, order, value) -> Iterable[tuple]:
        while self.stack and value is not None and self.stack[-1] <= value:
            self.stack.pop()
        found = self.stack[-1] if self.stack and value is not None else None
        if value is not None:
            self.stack.append(value)
        return [(order, value, found)]


class Rows(Machine):
    """Items in rows; an item joins the current row while it is within ``tolerance`` of the row's first item."""

    def __init__(self, tolerance: float):
        self.tolerance, self.number, self.start, self.n = tolerance, 0, None, 0

    def row(self, at: float) -> Iterable[tuple]:
        if self.start is not None and abs(at - self.start) <= self.tolerance:
            self.n += 1
            return ()
        done = self.end()
        self.number, self.start, self.n = self.number + 1, at, 1
        return done

    def end(self) -> Iterable[tuple]:
        return [(self.number, self.start, self.n)] if self.n else []


class FirstGroup(Machine):
    """Items in groups; an item joins the first earlier group within ``tolerance``, whichever it is."""

    def __init__(self, tolerance: float):
        self.tolerance = tolerance
        self.starts: list[float] = []
        self.sizes: list[int] = []

    def row(self, at: float) -> Iterable[tuple]:
        found = next((i for i, s in enumerate(self.starts) if abs(s - at) <= self.tolerance), None)
        if found is None:
            self.starts.append(at)
            self.sizes.append(1)
        else:
            self.sizes[found] += 1
        return ()

    def end(self) -> Iterable[tuple]:
        return [(i + 1, s, n) for i, (s, n) in enumerate(zip(self.starts, self.sizes, strict=True))]


class Spaced(Machine):
    """Single characters set apart become one line again: tops within half a height, gaps under three heights."""

    def __init__(self):
        self.line: list | None = None

    def row(self, y0: float, x0: float, x1: float, y1: float, text: str) -> Iterable[tuple]:
        if self.line:
            a0, b0, b1, a1, before, single = self.line
            h = a1 - a0
            if single and len(text) == 1 and abs(y0 - a0) < 0.5 * h and x0 - b1 < 3 * h and x0 >= b0:
                self.line = [a0, b0, x1, max(a1, y1), before + text, True]
                return ()
        done = self.end()
        self.line = [y0, x0, x1, y1, text, len(text) == 1]
        return done

    def end(self) -> Iterable[tuple]:
        return [tuple(self.line[:5])] if self.line else []


class Anchors(Machine):
    """Numbers of exercises in a document, with chapters or without.

    A walk begins at a page with a heading and goes from page to page until two in a row bring nothing, a table of
    contents comes, or a page with a chapter's opener or a stop is done. In an exam it begins with the first page and
    goes on to the last.
    """

    EMPTY = 2

    def __init__(self, skip: int):
        self.skip = skip
        self.walking, self.start, self.page, self.empty, self.found, self.flag = False, None, None, 0, 0, None
        self.inside, self.heading_page, self.last, self.expected = False, -99, None, 1
        self.mode = self.prefixed = None
        self.plain: dict[int, int] = {}
        self.plain_last, self.section, self.section_starts, self.walks = 0, 0, False, 0

    def _turn(self, page: int, exam: bool, flag: str | None) -> None:
        """Whether the walk goes on to ``page``, or one begins there."""
        if self.page is None and exam:
            self.inside, self.heading_page = True, page
        if self.walking:
            self.empty = 0 if self.found else self.empty + 1
            self.empty += page - self.page - 1 if page > self.page + 1 else 0  # pages without any line
            over = self.page != self.start and self.flag in ("opener", "stop") or self.empty >= self.EMPTY and not exam or flag == "toc"
            if over:
                self.walking, self.inside = False, exam
        if not self.walking and (flag == "heading" or exam and self.page is None):
            self.walking, self.start, self.empty = True, page, 0
            self.mode = self.prefixed = None
            self.walks += 1
        self.page, self.flag, self.found = page, flag, 0

    def row(self, page: int, y0: float, x0: float, exam: bool, flag: str | None, page_chapter: int | None, kind: str | None, opener: int | None, section: int | None, left: bool, candidates: list[dict], prefixed: bool, number: int | None) -> Iterable[tuple]:
        if page != self.page:
            self._turn(page, exam, flag)
        if not self.walking:
            return ()
        if exam and section is not None:
            self.section = section or self.section + 1
            self.inside, self.heading_page, self.section_starts = True, page, True
        elif kind == "opener" and opener is not None and opener == self.last:
            pass  # the running title of this chapter
        elif kind in ("opener", "stop"):
            self.inside = False
        elif kind == "heading":
            self.inside, self.heading_page = True, page
        elif self.inside and left:
            pairs = [] if self.mode == "plain" else [(c["ch"], c["k"]) for c in candidates or ()]
            if pairs and self.prefixed and not prefixed:
                return ()
            chosen = self._chapter(page, pairs, prefixed) if pairs else self._number(page, exam, page_chapter, number) if self.mode != "prefixed" and number is not None else None
            if chosen:
                self.found += 1
                chapter, k, gap = chosen
                return [(page, y0, x0, chapter, k, gap)]
        return ()

    def _chapter(self, page: int, pairs: list[tuple[int, int]], prefixed: bool) -> tuple[int, int, list[int]] | None:
        same = [k for ch, k in pairs if ch == self.last]
        near = page - self.heading_page <= 1
        chosen = next(((self.last, k) for k in same if k == self.expected), None)
        chosen = chosen or next(((self.last, k) for k in same if self.expected < k <= self.expected + self.skip), None)
        gap = list(range(self.expected, chosen[1])) if chosen else []
        chosen = chosen or next(((ch, k) for ch, k in pairs if k == 1 and ch >= 1 and near), None)
        if not chosen:
            return None
        self.last, self.expected, self.mode = chosen[0], chosen[1] + 1, "prefixed"
        self.prefixed = prefixed if self.prefixed is None else self.prefixed
        return (*chosen, gap)

    def _number(self, page: int, exam: bool, page_chapter: int | None, k: int) -> tuple[int, int, list[int]] | None:
        chapter = (self.section or 1) if exam else page_chapter or self.walks
        want = self.plain.get(chapter, 1)
        ahead = want < k <= want + self.skip
        restart = k == 1 and (page - self.heading_page <= 1 or self.section_starts)
        carried = exam and self.section_starts and k == self.plain_last + 1
        if not (k == want or ahead or restart or carried):
            return None
        self.plain[chapter] = k + 1
        self.plain_last, self.mode, self.section_starts = k, "plain", False
        return chapter, k, list(range(want, k)) if ahead else []


class Chain(Machine):
    """The longest chain with growing line and growing (chapter, index); rows come by line. Of equal lengths the later
    end wins and, before it, the later predecessor.

    A binary indexed tree over the ranks of (chapter, index) knows the longest chain that ends below a rank, so a row
    costs the logarithm of their number. Rows of one line are entered together, after all of them have been asked.
    """

    def __init__(self):
        self.items: list[tuple] = []

    def row(self, line, chapter: int, k: int) -> Iterable[tuple]:
        self.items.append((line, (chapter, k)))
        return ()

    def end(self) -> Iterable[tuple]:
        ranks = {c: r for r, c in enumerate(sorted({c for _, c in self.items}), 1)}
        tree: list[tuple[int, int]] = [(0, -1)] * (len(ranks) + 1)
        back: list[int] = []
        best, waiting, line_now = (0, -1), [], None
        for x, (line, c) in enumerate(self.items):
            if line != line_now:
                self._enter(tree, waiting)
                waiting, line_now = [], line
            r, top = ranks[c] - 1, (0, -1)
            while r > 0:
                top = max(top, tree[r])
                r &= r - 1
            back.append(top[1])
            waiting.append((ranks[c], (top[0] + 1, x)))
            best = max(best, (top[0] + 1, x))
        x, chain = best[1], []
        while x >= 0:
            chain.append(self.items[x][1])
            x = back[x]
        return [(best[0], " ".join(f"{a}.{b}" for a, b in reversed(chain)))]

    @staticmethod
    def _enter(tree: list[tuple[int, int]], waiting: list[tuple[int, tuple[int, int]]]) -> None:
        for r, value in waiting:
            while r < len(tree):
                tree[r] = max(tree[r], value)
                r += r & -r
