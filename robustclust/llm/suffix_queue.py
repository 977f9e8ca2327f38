"""External induced sorting of suffix tuples: disk-backed queues that carry suffixes with their common prefixes.

A tuple is a position with the bytes from it on (``right``) and those before it, nearest first (``left``). Runs of a page
are sorted by ``right``, written to disk and merged page by page: the queue gives every tuple up to the least of the
runs' page ends at once. What leaves it is a stream of numbers, each with the common prefix of its suffix and the one
before. From that stream the order of the suffixes that begin one byte earlier is induced, and from that recursively the
order of those two, three, ... bytes earlier: a stream is dealt into one queue a preceding byte, and the queues, read in
order of their bytes, are the next stream; its common prefixes are one more than the least that lay between.

In any stream, suffixes that agree in ``length`` bytes stand together: of such a run all but those of the first document
are marked. Only pages are in memory; queues, tuples, marks and the members of runs that outgrow a page are files that
vanish with the task.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: the greatest common prefix that fits a stream's entry, of which the low byte holds it and the rest the number
MOST_PREFIX = 255
LAST = np.iinfo(np.int64).max


class Spool:
    """A first-in-first-out queue of array pages; those that its store has no room for are on disk."""

    def __init__(self, store: Store, kind):
        self.store, self.kind, self.parts, self.file = store, np.dtype(kind), [], None
        store.spools.append(self)

    def push(self, page: np.ndarray) -> None:
        if len(page):
            self.parts.append(page)
            self.store.grew(len(page))

    def flush(self) -> None:
        if self.parts:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.seek(0, 2)
            for part in self.parts:
                np.ascontiguousarray(part).tofile(self.file)
            self.parts = []

    def pages(self, rows: int) -> Iterator[np.ndarray]:
        if self.file:
            self.flush()
            self.file.seek(0)
            while len(page := np.fromfile(self.file, self.kind, rows)):
                yield page
        else:
            yield from self.parts

    def close(self) -> None:
        self.parts = []
        if self.file:
            self.file.close()


class Store:
    """Spools that share a page of memory: when their entries outgrow it, all are written out."""

    def __init__(self, room: int):
        self.room, self.held, self.spools = room, 0, []

    def grew(self, n: int) -> None:
        self.held += n
        if self.held > self.room:
            for spool in self.spools:
                spool.flush()
            self.held = 0

    def close(self) -> None:
        for spool in self.spools:
            spool.close()


class Column:
    """An array that grows at its end and is then read at random: in memory up to ``room`` rows, else mapped from disk."""

    def __init__(self, kind, room: int, shape: tuple = ()):
        self.kind, self.room, self.shape, self.parts, self.rows, self.file = np.dtype(kind), room, shape, [], 0, None

    def push(self, values: np.ndarray) -> None:
        self.parts.append(np.ascontiguousarray(values, self.kind))
        self.rows += len(values)
        if self.rows > self.room:
            self.file = self.file or tempfile.TemporaryFile()
            for part in self.parts:
                part.tofile(self.file)
            self.parts = []

    def read(self) -> np.ndarray:
        if self.file:
            self.file.flush()
            return np.memmap(self.file, self.kind, "r+", shape=(self.rows, *self.shape))
        return np.concatenate([np.zeros((0, *self.shape), self.kind), *self.parts])


def sort_words(right: np.ndarray) -> list[np.ndarray]:
    """Rows of bytes as big-endian words, most significant first."""
    wide = np.zeros((len(right), -(-right.shape[1] // 8) * 8), np.uint8)
    wide[:, : right.shape[1]] = right
    return list(wide.view(">u8").astype(np.uint64).T)


def range_minima(values: np.ndarray) -> list[np.ndarray]:
    levels, width = [values], 1
    while 2 * width <= len(values):
        levels.append(np.minimum(levels[-1][:-width], levels[-1][width:]))
        width *= 2
    return levels


def minimum_between(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum over [a, b) with a < b."""
    level = np.frexp((b - a).astype(float))[1] - 1
    out = np.empty(len(a), levels[0].dtype)
    for k in np.unique(level):
        at = level == k
        out[at] = np.minimum(levels[k][a[at]], levels[k][b[at] - (1 << int(k))])
    return out


class SuffixQueue:
    """The tuples of a shard, and which of the strings that begin before their positions an earlier document has."""

    def __init__(self, page: int, length: int = 50):
        self.page, self.length, self.rows = page, length, 0
        self.chunks: list[tuple[int, int]] = []  # (chunk, tuples) in order of arrival
        self.runs, self.held, self.held_rows = [], [], 0
        self.columns: dict[str, Column] = {}

    def push(self, chunk: int, tuples: np.ndarray) -> None:
        self.chunks.append((chunk, len(tuples)))
        for name in ("doc", "lo", "hi", "left"):
            kind = tuples.dtype[name]
            self.columns.setdefault(name, Column(kind.base, self.page, kind.shape)).push(tuples[name])
        for a in range(0, len(tuples), self.page):
            part = tuples["right"][a : a + self.page]
            if self.held_rows + len(part) > self.page:
                self._close_run()
            self.held.append((np.arange(self.rows + a, self.rows + a + len(part)), part))
            self.held_rows += len(part)
        self.rows += len(tuples)

    def _sorted(self) -> np.ndarray:
        number = np.concatenate([x for x, _ in self.held])
        right = np.concatenate([x for _, x in self.held])
        order = np.lexsort(sort_words(right)[::-1])
        out = np.empty(len(number), np.dtype([("number", "<u8"), ("right", f"S{right.shape[1]}")]))
        out["number"] = number[order]
        out["right"] = np.ascontiguousarray(right[order]).view(f"S{right.shape[1]}").ravel()
        self.held, self.held_rows = [], 0
        return out

    def _close_run(self) -> None:
        if self.held:
            run = Spool(Store(0), np.dtype([("number", "<u8"), ("right", f"S{self.held[0][1].shape[1]}")]))
            run.push(self._sorted())
            self.runs.append(run)

    def merged(self) -> Iterator[np.ndarray]:
        """All tuples in order of their bytes, as pages of (number, right)."""
        if not self.runs:
            if self.held:
                yield self._sorted()
            return
        self._close_run()
        rows = max(64, self.page // len(self.runs))
        feeds = [run.pages(rows) for run in self.runs]
        heads = [next(feed, None) for feed in feeds]
        while any(h is not None for h in heads):
            bound = min(h["right"][-1] for h in heads if h is not None)
            out = []
            for i, h in enumerate(heads):
                if h is None:
                    continue
                n = int(np.searchsorted(h["right"], bound, "right"))
                out.append(h[:n])
                heads[i] = h[n:] if n < len(h) else next(feeds[i], None)
            page = np.concatenate(out)
            wide = np.ascontiguousarray(page["right"]).view(np.uint8).reshape(len(page), -1)
            yield page[np.lexsort((page["number"], *sort_words(wide)[::-1]))]
        for run in self.runs:
            run.close()

    def _first_stream(self, store: Store) -> Spool:
        """Entries (number, common prefix with the entry before) in order of the suffixes at the positions themselves."""
        out, before = Spool(store, np.uint64), None
        for page in self.merged():
            right = np.ascontiguousarray(page["right"]).view(np.uint8).reshape(len(page), -1)
            above = np.concatenate([right[:1] if before is None else before, right[:-1]])
            same = right == above
            prefix = np.where(same.all(axis=1), right.shape[1], same.argmin(axis=1))
            if before is None:
                prefix[0] = 0
            before = right[-1:]
            out.push(page["number"] << np.uint64(8) | prefix.astype(np.uint64))
        return out

    def _earlier_stream(self, stream: Spool, d: int, left: np.ndarray, hi: np.ndarray, store: Store) -> list[Spool]:
        """The stream of the suffixes that begin ``d`` bytes before the positions, from that of ``d`` - 1: a queue a byte."""
        queues: dict[int, Spool] = {}
        gap = np.full(256, MOST_PREFIX, np.int64)  # the least prefix since the last entry of each queue
        seen = np.zeros(256, bool)
        for page in self._pages(stream):
            number, prefix = (page >> np.uint64(8)).astype(np.int64), (page & np.uint64(255)).astype(np.uint8)
            at = np.flatnonzero(hi[number] >= d)
            byte = left[number[at], d - 1]
            turn = np.argsort(byte, kind="stable")
            at, byte = at[turn], byte[turn]
            if len(at):
                levels = range_minima(prefix)
                new = np.concatenate([[True], byte[1:] != byte[:-1]])
                start = np.concatenate([[0], at[:-1] + 1])
                start[new] = 0
                common = minimum_between(levels, start, at + 1).astype(np.int64)
                common[new] = np.minimum(common[new], gap[byte[new]])
                common = np.minimum(common + 1, MOST_PREFIX)
                common[np.flatnonzero(new)[~seen[byte[new]]]] = 0
                entries = (number[at] << 8 | common).astype(np.uint64)
                head = np.flatnonzero(new)
                ends = [*head[1:].tolist(), len(at)]
                present = byte[head]
                for b, i, j in zip(present.tolist(), head.tolist(), ends, strict=True):
                    if b not in queues:
                        queues[b] = Spool(store, np.uint64)
                    queues[b].push(entries[i:j])
                seen[present] = True
            whole = int(prefix.min())
            gap = np.minimum(gap, whole)
            if len(at):
                last = at[np.array(ends) - 1]
                rest = np.full(len(present), MOST_PREFIX)
                inner = last + 1 < len(prefix)
                if inner.any():
                    rest[inner] = minimum_between(levels, last[inner] + 1, np.full(int(inner.sum()), len(prefix)))
                gap[present] = rest
        return [queues[b] for b in sorted(queues)]

    def _pages(self, stream) -> Iterator[np.ndarray]:
        """A stream's entries in pages: what its queues hold in memory is joined, as most hold little."""
        held, n = [], 0
        for spool in stream:
            for page in spool.pages(self.page):
                if held and n + len(page) > self.page:
                    yield np.concatenate(held)
                    held, n = [], 0
                held.append(page)
                n += len(page)
        if held:
            yield np.concatenate(held)

    def _mark(self, stream, d: int, doc: np.ndarray, lo: np.ndarray, marks: np.ndarray) -> None:
        """Sets bit ``d`` of every entry whose run, of equal strings, has an entry of an earlier document."""
        bit = np.uint64(1) << np.uint64(d)
        store = Store(self.page)
        run, least = Spool(store, np.int64), LAST  # the members of the run that is still open

        def settle():
            for number in run.pages(self.page):
                marks[number[doc[number] > least]] |= bit
            store.close()

        for page in self._pages(stream):
            number, prefix = (page >> np.uint64(8)).astype(np.int64), page & np.uint64(255)
            head = np.flatnonzero(prefix < self.length)
            own = lo[number] <= d
            value = np.where(own, doc[number], LAST)
            first = int(head[0]) if len(head) else len(page)
            if first:  # the open run goes on
                least = min(least, int(value[:first].min()))
                run.push(number[:first][own[:first]])
            if not len(head):
                continue
            settle()
            store = Store(self.page)
            size = np.diff(np.concatenate([head, [len(page)]]))
            lowest = np.minimum.reduceat(value, head)
            final = int(head[-1])
            later = (value[first:] > np.repeat(lowest, size)) & own[first:]
            later[final - first :] = False
            marks[number[first:][later]] |= bit
            run, least = Spool(store, np.int64), int(lowest[-1])
            run.push(number[final:][own[final:]])
        settle()

    def marked(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(chunk, first of its tuples, marks) with a bit for each string, by the bytes it begins before the position.

        Parts without a mark are left out; a chunk's tuples are numbered in the order of their arrival.
        """
        if not self.rows:
            return
        columns = {name: c.read() for name, c in self.columns.items()}
        doc, lo, hi, left = (columns[name] for name in ("doc", "lo", "hi", "left"))
        blank = Column(np.uint64, self.page)
        for a in range(0, self.rows, self.page):
            blank.push(np.zeros(min(self.page, self.rows - a), np.uint64))
        marks = blank.read()
        store = Store(self.page)
        stream = [self._first_stream(store)]
        for d in range(left.shape[1] + 1):
            if d:
                before, store = store, Store(self.page)
                stream = self._earlier_stream(stream, d, left, hi, store)
                before.close()
                if not stream:
                    break
            self._mark(stream, d, doc, lo, marks)
        store.close()
        at = 0
        for chunk, n in self.chunks:
            for a in range(at, at + n, self.page):
                b = min(a + self.page, at + n)
                found = np.array(marks[a:b])
                if found.any():
                    yield chunk, a - at, found
            at += n
