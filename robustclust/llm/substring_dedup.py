"""Suffix-based substring dedup: bytes covered by long strings that an earlier document has too.

Suffixes are sorted by induction from a sample. The sample is content-defined: of every ``LENGTH``-byte string the
position of the least hashed ``GRAM``-gram (the rightmost of equals), so equal strings have the same sampled position.
Sampled positions whose gram occurs in one document only can't be in a shared string. Of the others, those whose whole
surroundings (all that their strings cover) an earlier document has go whole, by a hash of these. Where a gram has
different surroundings that agree on one side as far as a shared string takes, the first document with each of them
sends a suffix tuple (the bytes from the position on, those before it, the document) to the shard of the gram. Shards
are sorted externally and the order of the suffixes that begin 1, 2, ... bytes earlier is induced from them, common
prefixes along, by the disk-backed queues of ``suffix_queue``; of suffixes that agree in ``LENGTH`` bytes all but those
of the first document are marked.

Shards are dealt by hash and each chunk of texts sends a tuple once however often it has it, so no string, however
common, gathers more than one tuple a chunk in a shard. What a shard decides about a chunk's grams, surroundings or
tuples goes back as bits, in the order in which the chunk sent them and works them out again. A gram of more than
``HOT_SAMPLES`` samples (at the edge of a passage that a large part of the corpus shares, followed by something else
each time) would still gather a tuple a document: its strings are dealt out one by one by their own hashes instead, each
once a chunk, and judged by these. Grams are identified by 64-bit hashes, surroundings by 48 bits more; tuples by their
bytes.

Defined results: a null text is empty; rows with the same doc_id, identical rows too, never count as earlier than one
another; a null doc_id is later than all others; texts shorter than ``LENGTH`` keep all bytes; a text of any length is
one chunk at least; an empty table gives no rows; extra columns are ignored, whatever their names; ids are whole numbers.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from robustclust.llm.session import buckets_for, freed, light_batches, new_folder, scratch, staged, text_bytes, unstaged
from robustclust.llm.suffix_queue import SuffixQueue
from robustclust.llm.textops import U64, column_bytes, mix, powers, prefix_hash, span_hash, text_chunks

LENGTH, GRAM = 50, 16
REACH = LENGTH - GRAM
#: two surroundings share a string only if they agree in so many bytes before the position, or in so many from it on
LEFT_PART = REACH // 2 + 1
RIGHT_PART = LENGTH - REACH // 2
CHUNK_BYTES, CHUNK_ROWS, PIECE_BYTES = 6 << 20, 1 << 20, 256 << 10
TEXT_PER_SHARD = 3 << 20
#: tuples of a sorted run and of a page; a shard of more goes through files
RUN_TUPLES = 1 << 18
KEY_BITS = 39
#: bytes of the hashes of surroundings (within their gram) and of their parts
KEY_BYTES, PART_BYTES = 6, 3
#: samples of a gram above which its strings are dealt one by one, as its tuples would fill a task
HOT_SAMPLES = 1 << 16
LAST = np.iinfo(np.int64).max
TUPLE = np.dtype([("doc", "<i8"), ("lo", "u1"), ("hi", "u1"), ("left", f"({REACH},)u1"), ("right", f"({LENGTH},)u1")])


def sample(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, lo, hi, gram hash) of the sampled positions; strings starting lo to hi bytes before it are its own."""
    n, none = len(body), np.zeros(0, np.int64)
    long = np.flatnonzero(np.diff(offsets) >= LENGTH)
    if not len(long):
        return none, none, none, none, np.zeros(0, np.uint64)
    _, down = powers(n + 1)
    prefix = prefix_hash(body)
    gram = prefix[GRAM:] - prefix[:-GRAM]
    gram *= down[: n - GRAM + 1]
    gram = mix(gram)
    # the least key is the least hash, and of equal hashes the rightmost
    key = gram & U64(0xFFFFFFFF00000000)
    key |= np.arange(n, n - len(key), -1, dtype=np.uint64)
    least, width = key, 1
    while 2 * width <= REACH + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < REACH + 1:
        least = np.minimum(least[: width - REACH - 1], least[REACH + 1 - width :])
    first, final = offsets[:-1][long], offsets[1:][long] - LENGTH
    turn = np.ones(len(least), bool)
    np.not_equal(least[1:], least[:-1], out=turn[1:])
    turn[first] = True
    step = np.zeros(len(least) + 1, np.int8)
    step[first] += 1
    step[final + 1] -= 1
    start = np.flatnonzero(turn & np.cumsum(step[:-1], dtype=np.int8).view(bool))
    row = np.searchsorted(first, start, "right") - 1
    end = np.minimum(np.concatenate([start[1:], [len(least)]]) - 1, final[row])
    place = n - (least[start] & U64(0xFFFFFFFF)).astype(np.int64)
    return long[row], place, place - end, place - start, gram[place]


def shard_of(gram: np.ndarray, shards: int) -> np.ndarray:
    return ((gram >> U64(KEY_BITS)) * U64(shards) >> U64(64 - KEY_BITS)).astype(np.int64)


def _pack(x: np.ndarray, size: int) -> bytes:
    """Low bytes of unsigned numbers."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def _unpack(raw: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(raw) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8).reshape(-1, size)
    return out.view("<u8").ravel()


def _chunk_rows(chunk_bytes: int):
    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=3)
        no = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 24
        for batch in batches:
            body, offsets = column_bytes(batch.column(1))
            ids = batch.column(0)
            known = ids.fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)
            null = ids.is_null().to_numpy(zero_copy_only=False)
            for i, j, part, off in text_chunks(body, offsets, chunk_bytes, CHUNK_ROWS):
                head = np.concatenate([known[i:j], np.diff(off)]).astype("<i8").tobytes() + null[i:j].tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([no]), pa.array([squeeze.compress(head)], pa.binary()), pa.array([squeeze.compress(part.tobytes())], pa.binary())], names=["chunk", "head", "texts"])
                no += 1

    return run


def _open(head: bytes, texts: bytes):
    """(doc ids, null ids, bytes, offsets) of a chunk."""
    raw = zstandard.ZstdDecompressor().decompress(head)
    rows = len(raw) // 17
    numbers = np.frombuffer(raw[: 16 * rows], "<i8")
    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(texts), np.uint8)
    return numbers[:rows], np.frombuffer(raw[16 * rows :], bool), body, np.concatenate([[0], np.cumsum(numbers[rows:])])


def _samples(docs, body, offsets):
    """The sampled positions of a chunk, worked out in pieces."""
    parts = []
    for i, _, part, off in text_chunks(body, offsets, PIECE_BYTES, CHUNK_ROWS):
        row, place, lo, hi, gram = sample(part, off)
        parts.append((row + i, place + offsets[i], lo, hi, gram))
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)]


def _by_shard(shard: np.ndarray, shards: int):
    """(shard, from, to) of the runs of a sorted array of shards."""
    cut = np.searchsorted(shard, np.arange(shards + 1))
    return [(int(k), int(cut[k]), int(cut[k + 1])) for k in np.flatnonzero(np.diff(cut))]


def _block_rows(runs, chunk: int, blocks: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in runs], pa.int32()), pa.array([chunk] * len(runs), pa.int64()), pa.array(blocks, pa.binary())], names=["shard", "chunk", "block"])


def _grams(shards: int):
    """For each shard the grams sampled in a chunk, each once, with the number of its samples and a bit for several documents."""

    def run(batches):
        for batch in batches:
            for chunk, head, texts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                docs, _, body, offsets = _open(head, texts)
                row, _, _, _, gram = _samples(docs, body, offsets)
                order = np.argsort(gram, kind="stable")
                gram, doc = gram[order], docs[row[order]]
                first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
                several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first) if len(first) else np.zeros(0, bool)
                gram, often = gram[first], np.diff(np.concatenate([first, [len(gram)]]))
                low = (gram & U64((1 << KEY_BITS) - 1)) << U64(1) | several.astype(np.uint64)
                runs, blocks = _by_shard(shard_of(gram, shards), shards), []
                for _, a, b in runs:
                    more = np.flatnonzero(often[a:b] > 1)  # few grams come more than once in a chunk
                    counts = np.column_stack([more, often[a:b][more]]).astype("<i4").tobytes()
                    blocks.append(np.int32(b - a).tobytes() + _pack(low[a:b], 5) + counts)
                yield _block_rows(runs, chunk, blocks)

    return run


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def _shared(hot_samples: int):
    """Told to each chunk: which of the grams it sent several documents have, and which of these have very many samples."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        parts, times = [], []
        for b in group["block"]:
            n = int(np.frombuffer(b[:4], "<i4")[0])
            parts.append(_unpack(b[4 : 4 + 5 * n], 5))
            count, more = np.ones(n, np.int64), np.frombuffer(b[4 + 5 * n :], "<i4").reshape(-1, 2)
            count[more[:, 0]] = more[:, 1]
            times.append(count)
        raw = np.concatenate(parts)
        gram, several = raw >> U64(1), (raw & U64(1)).astype(bool)
        order = np.argsort(gram, kind="stable")
        head = np.concatenate([[True], np.diff(gram[order]) != 0])
        run = np.cumsum(head) - 1
        often = (np.bincount(run) > 1) | (np.bincount(run, several[order]) > 0)
        hot = often & (np.bincount(run, np.concatenate(times)[order]) > hot_samples)
        flag = np.empty(len(raw), np.int8)
        flag[order] = (often.astype(np.int8) + hot)[run]
        cut = np.cumsum([0, *map(len, parts)])
        told = [[_bits(flag[a:b] == kind) if (flag[a:b] == kind).any() else b"" for a, b in zip(cut, cut[1:], strict=False)] for kind in (1, 2)]
        out = pd.DataFrame({"chunk": group["chunk"].to_numpy(), "shard": group["shard"].to_numpy(), "block": told[0], "hot": told[1]})
        return out[[bool(a or b) for a, b in zip(*told, strict=True)]]

    return run


def _told(values: np.ndarray, told, field: str, shards: int) -> np.ndarray:
    """Which of a chunk's distinct grams, in order, the bits told to it name."""
    out = np.zeros(len(values), bool)
    runs = {k: (a, b) for k, a, b in _by_shard(shard_of(values, shards), shards)}
    for x in told or []:
        if x[field]:
            a, b = runs[x["shard"]]
            out[a:b] = _flags(x[field], b - a)
    return out


def _spans(body, start, end) -> np.ndarray:
    """Hashes of sorted spans, in pieces, as the powers of a whole chunk would be large."""
    out = np.empty(len(start), np.uint64)
    edges = np.arange(0, len(body) + PIECE_BYTES, PIECE_BYTES)
    cut = np.searchsorted(start, edges)
    for e, a, b in zip(edges, cut, cut[1:], strict=False):
        if a < b:
            prefix = prefix_hash(body[e : min(len(body), e + PIECE_BYTES + 2 * LENGTH)])
            out[a:b] = span_hash(prefix, start[a:b] - e, end[a:b] - e)
    return out


def _context_keys(body, place, lo, hi):
    """A hash of each sampled position's surroundings: the bytes that its own strings cover, and how they lie."""
    key = _spans(body, place - hi, place - lo + LENGTH)
    return mix(key + (lo | hi << 8).astype(np.uint64) * U64(0x9E3779B97F4A7C15))


def _part_hashes(body, place, lo, hi):
    """Short hashes of the surroundings' parts before and after the position; 0 where no own string reaches so far."""
    left = _spans(body, np.maximum(place - LEFT_PART, 0), place)
    right = _spans(body, place, np.minimum(place + RIGHT_PART, len(body)))
    top, short = U64((1 << 8 * PART_BYTES) - 2), lambda h: h >> U64(64 - 8 * PART_BYTES)
    return [np.where(own, np.minimum(short(h), top) + U64(1), U64(0)) for own, h in ((hi >= LEFT_PART, left), (lo <= LENGTH - RIGHT_PART, right))]


def _classes(key, doc):
    """(first place and least document of each distinct key, sorted by key; the class of every place)."""
    order = np.lexsort((doc, key))
    head = np.concatenate([[True], np.diff(key[order]) != 0]) if len(key) else np.zeros(0, bool)
    of = np.empty(len(key), np.int64)
    of[order] = np.cumsum(head) - 1
    return order[head], of


def _member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


class Surroundings:
    """A chunk's sampled positions of shared grams, their classes of equal surroundings, and how these go to the shards."""

    def __init__(self, head: bytes, texts: bytes, told, shards: int):
        self.docs, self.null, self.body, self.offsets = _open(head, texts)
        row, place, lo, hi, gram = _samples(self.docs, self.body, self.offsets)
        values, at = np.unique(gram, return_inverse=True)
        self.hot = np.flatnonzero(_told(values, told, "hot", shards)[at])
        self.sampled = row, place, lo, hi
        hit = _told(values, told, "block", shards)[at]
        self.row, self.place, self.lo, self.hi, self.gram = (x[hit] for x in (row, place, lo, hi, gram))
        self.key = _context_keys(self.body, self.place, self.lo, self.hi)
        shard = shard_of(self.gram, shards)
        order = np.lexsort((self.docs[self.row], self.key, shard))
        k, s = self.key[order], shard[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])])[: len(order)]
        #: the first position of each class, with its least document; the class of each position; (shard, from, to)
        self.first, self.of = order[new], np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.runs = _by_shard(shard[self.first], shards)

    def codes(self, told) -> np.ndarray:
        """What the shards decided about the classes: 1 they go whole, 2 their tuples decide, else 0."""
        out, runs = np.zeros(len(self.first), np.int8), {k: (a, b) for k, a, b in self.runs}
        for x in told or []:
            a, b = runs[x["shard"]]
            half = len(x["codes"]) // 2
            out[a:b] = _flags(x["codes"][:half], b - a) + 2 * _flags(x["codes"][half:], b - a).astype(np.int8)
        return out

    def strings(self):
        """(start, hash, document) of every string whose sampled gram is hot."""
        row, place, lo, hi = (x[self.hot] for x in self.sampled)
        count = hi - lo + 1
        first = place - hi
        start = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()) if len(row) else np.zeros(0, np.int64)
        return start, _spans(self.body, start, start + LENGTH), np.repeat(self.docs[row], count)


def _hot_strings(shards: int):
    """For each shard of the hot strings' own hashes: hash and least document, each once a chunk."""

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for chunk, head, texts, told in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                _, hashed, doc = Surroundings(head, texts, told, shards).strings()
                first, _ = _classes(hashed, doc)
                hashed, doc = hashed[first], doc[first]  # sorted by hash, so by shard too
                runs = _by_shard(shard_of(hashed, shards), shards)
                yield _block_rows(runs, chunk, [squeeze.compress(hashed[a:b].tobytes() + doc[a:b].tobytes()) for _, a, b in runs])

    return run


def _later_strings(group: pd.DataFrame) -> pd.DataFrame:
    """Told to each chunk: the hashes that an earlier document elsewhere has."""
    parts = []
    for block in group["block"]:
        raw = zstandard.ZstdDecompressor().decompress(block)
        parts.append((np.frombuffer(raw[: len(raw) // 2], "<u8"), np.frombuffer(raw[len(raw) // 2 :], "<i8")))
    hashed, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
    first, of = _classes(hashed, doc)
    later = doc > doc[first][of]
    cut = np.cumsum([0, *(len(x[0]) for x in parts)])
    rows = [(c, hashed[a:b][later[a:b]].tobytes()) for c, a, b in zip(group["chunk"], cut, cut[1:], strict=False)]
    return pd.DataFrame([r for r in rows if r[1]], columns=["chunk", "block"]).astype({"chunk": "int64"})


def _contexts(shards: int):
    """For each shard the surroundings of a chunk's shared grams, each once: gram, key, hashes of its parts, least document."""

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for chunk, head, texts, told in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                x = Surroundings(head, texts, told, shards)
                f = x.first
                low, doc = x.gram[f] & U64((1 << KEY_BITS) - 1), x.docs[x.row[f]]
                parts = [np.empty(0, np.uint64)] * 2
                if len(f):
                    turn = np.argsort(x.place[f])  # spans are hashed in order of their places
                    parts = [np.empty(len(f), np.uint64) for _ in range(2)]
                    for out, made in zip(parts, _part_hashes(x.body, x.place[f][turn], x.lo[f][turn], x.hi[f][turn]), strict=True):
                        out[turn] = made
                fields = ((low, 5), (x.key[f], KEY_BYTES), (parts[0], PART_BYTES), (parts[1], PART_BYTES))
                yield _block_rows(x.runs, chunk, [squeeze.compress(b"".join(_pack(v[a:b], n) for v, n in fields) + doc[a:b].tobytes()) for _, a, b in x.runs])

    return run


def _joint(gram, part, doc) -> np.ndarray:
    """Which rows share gram and part with a row of another document."""
    order = np.lexsort((part, gram))
    g, p, d = gram[order], part[order], doc[order]
    head = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (p[1:] != p[:-1])]))
    several = np.minimum.reduceat(d, head) != np.maximum.reduceat(d, head)
    out = np.empty(len(gram), bool)
    out[order] = np.repeat(several, np.diff(np.concatenate([head, [len(g)]])))
    return out & (part > 0)


def _coded(group: pd.DataFrame) -> pd.DataFrame:
    """Told to each chunk, in the order of what it sent: which surroundings go whole, as an earlier document has the same;
    and whose tuples decide, as other surroundings of the gram agree with them on one side as far as a shared string takes."""
    parts, width = [], 5 + KEY_BYTES + 2 * PART_BYTES
    for block in group["block"]:
        raw = zstandard.ZstdDecompressor().decompress(block)
        n = len(raw) // (8 + width)
        at = np.cumsum([0, 5, KEY_BYTES, PART_BYTES, PART_BYTES]) * n
        parts.append((*(_unpack(raw[a:b], int(b - a) // n) for a, b in zip(at, at[1:], strict=False)), np.frombuffer(raw[width * n :], "<i8")))
    gram, key, before, after, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((doc, key, gram))
    g, k, d = gram[order], key[order], doc[order]
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (k[1:] != k[:-1])])
    least = d[np.maximum.accumulate(np.where(new, np.arange(len(d)), 0))]
    one = order[new]  # each distinct key once, with its least document
    open_ = _joint(gram[one], before[one], doc[one]) | _joint(gram[one], after[one], doc[one])
    code = np.empty(len(d), np.int8)
    code[order] = np.where(d > least, 1, np.where(open_[np.cumsum(new) - 1], 2, 0))
    cut = np.cumsum([0, *(len(x[0]) for x in parts)])
    rows = [(c, s, _bits(code[a:b] == 1) + _bits(code[a:b] == 2), bool((code[a:b] == 2).any())) for c, s, a, b in zip(group["chunk"], group["shard"], cut, cut[1:], strict=False) if code[a:b].any()]
    return pd.DataFrame(rows, columns=["chunk", "shard", "codes", "open"]).astype({"chunk": "int64", "shard": "int32", "open": "bool"})


def _tuples(shards: int):
    """The suffix tuples of the classes that need them."""

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for chunk, head, texts, told, codes in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                x = Surroundings(head, texts, told, shards)
                open_ = x.codes(codes) == 2
                padded = np.concatenate([np.zeros(REACH, np.uint8), x.body, np.zeros(LENGTH, np.uint8)])
                runs, blocks, at = [], [], 0
                for shard, a, b in x.runs:
                    f = x.first[a:b][open_[a:b]]
                    if not len(f):
                        continue
                    t = np.zeros(len(f), TUPLE)
                    t["doc"], t["lo"], t["hi"] = x.docs[x.row[f]], x.lo[f], x.hi[f]
                    span = padded[x.place[f][:, None] + np.arange(REACH + LENGTH)]
                    # bytes outside its own strings decide nothing
                    t["left"] = np.where(np.arange(REACH) < t["hi"][:, None], span[:, REACH - 1 :: -1], 0)
                    t["right"] = np.where(np.arange(LENGTH) < LENGTH - t["lo"][:, None], span[:, REACH:], 0)
                    # column by column it compresses better
                    blocks.append(squeeze.compress(b"".join(t[name].tobytes() for name in TUPLE.names)))
                    runs.append((shard, at, at := at + len(f)))
                yield _block_rows(runs, chunk, blocks)

    return run


def _read_tuples(block: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(block)
    n, at = len(raw) // TUPLE.itemsize, 0
    out = np.zeros(n, TUPLE)
    for name in TUPLE.names:
        kind = TUPLE[name]
        out[name] = np.frombuffer(raw, kind.base, n * int(np.prod(kind.shape)), at).reshape(n, *kind.shape)
        at += n * kind.itemsize
    return out


def _mark_rows(frames, page: int = RUN_TUPLES):
    """From blocks of tuples in order of their shards: (chunk, shard, first tuple, marks) of parts with any mark."""
    shard, queue = None, None
    for frame in frames:
        for no, chunk, block in zip(frame["shard"], frame["chunk"], frame["block"], strict=True):
            if no != shard:
                if queue:
                    yield from ((c, shard, at, marks) for c, at, marks in queue.marked())
                shard, queue = no, SuffixQueue(page)
            queue.push(int(chunk), _read_tuples(block))
    if queue:
        yield from ((c, shard, at, marks) for c, at, marks in queue.marked())


def _marks(frames):
    for chunk, shard, at, marks in _mark_rows(frames):
        yield pd.DataFrame({"chunk": [chunk], "shard": [np.int32(shard)], "at": [at], "marks": [_pack(marks, 5)]})


def removed_bytes(x: Surroundings, codes, marked, later: list[bytes]) -> np.ndarray:
    """Which bytes of a chunk go."""
    change = np.zeros(len(x.body) + 1, np.int32)
    code = x.codes(codes)
    every = U64((1 << REACH + 1) - 1)
    marks = np.where(code == 1, every, U64(0))
    open_ = {k: a + np.flatnonzero(code[a:b] == 2) for k, a, b in x.runs}
    for m in marked or []:
        found = _unpack(m["marks"], 5)
        marks[open_[m["shard"]][m["at"] : m["at"] + len(found)]] |= found
    mark = marks[x.of]
    mark[x.docs[x.row] > x.docs[x.row[x.first]][x.of]] = every  # an earlier document of the chunk has the same surroundings
    full = mark == every  # all its strings go: one run of bytes
    np.add.at(change, (x.place - x.hi)[full], 1)
    np.add.at(change, (x.place - x.lo)[full] + LENGTH, -1)
    some = np.flatnonzero((mark > 0) & ~full)
    for d in range(REACH + 1):
        k = some[((mark[some] >> U64(d)) & U64(1)).astype(bool)]
        at = (x.place[k] - d)[(x.lo[k] <= d) & (x.hi[k] >= d)]
        np.add.at(change, at, 1)
        np.add.at(change, at + LENGTH, -1)
    if len(x.hot):
        start, hashed, doc = x.strings()
        first, of = _classes(hashed, doc)
        known = np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(b, "<u8") for b in later or [])]))
        at = start[_member(hashed, known) | (doc > doc[first][of])]
        np.add.at(change, at, 1)
        np.add.at(change, at + LENGTH, -1)
    return np.cumsum(change[:-1]) > 0


def _finish(batches, shards: int):
    for batch in batches:
        for head, texts, told, codes, marked, later in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            x = Surroundings(head, texts, told, shards)
            docs, null, body, offsets = x.docs, x.null, x.body, x.offsets
            gone = removed_bytes(x, codes, marked, later)
            begins = gone & ~np.concatenate([[False], gone[:-1]])
            inner = offsets[(offsets > 0) & (offsets < len(body))]
            begins[inner] = gone[inner]
            total, spans = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(begins)])
            kept = [body[a:b][~gone[a:b]].tobytes() for a, b in zip(offsets, offsets[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(docs, pa.int64(), mask=null),
                    pa.array(np.diff(offsets)),
                    pa.array(np.diff(total[offsets])),
                    pa.array(np.diff(spans[offsets])),
                    pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
                    pa.array(kept, pa.binary()),
                ],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )


def _results(shards: int, names: list[str]):
    def run(batches):
        for batch in _finish(batches, shards):
            yield batch.select(names)

    return run


BLOCKS = "shard int, chunk long, block binary"


def dedup_substrings(docs: DataFrame, with_text: bool = False, hot_samples: int = HOT_SAMPLES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes) for every document; ids are whole numbers."""
    kind = dict(docs.dtypes)["doc_id"]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"doc_id orders the documents and has to be a whole number, not {kind}")
    spark = docs.sparkSession
    docs = light_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    with scratch(spark) as keep:
        size = text_bytes(docs)
        # bucketed by chunk, so that the later joins move only what is told to the chunks and never the texts
        spread = max(buckets_for(size, CHUNK_BYTES // 2, 12), int(spark.conf.get("spark.sql.shuffle.partitions")))
        name = f"substring_chunks_{uuid.uuid4().hex}"
        try:
            rows = docs.mapInArrow(_chunk_rows(chunk_bytes), "chunk long, head binary, texts binary")
            rows.write.bucketBy(spread, "chunk").option("path", new_folder(spark, "substring-chunks")).saveAsTable(name)
            out = _deduped(spark.table(name), buckets_for(size, TEXT_PER_SHARD, 64), hot_samples, with_text)
            return keep(out.withColumn("doc_id", F.col("doc_id").cast(kind)), "substring-result")
        finally:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def _deduped(chunks: DataFrame, shards: int, hot_samples: int, with_text: bool) -> DataFrame:
    spark = chunks.sparkSession
    shared = chunks.mapInArrow(_grams(shards), BLOCKS).groupBy("shard").applyInPandas(_shared(hot_samples), "chunk long, shard int, block binary, hot binary")
    told = staged(shared.groupBy("chunk").agg(F.collect_list(F.struct("shard", "block", "hot")).alias("told")), "substring-grams")
    freed(spark)
    contexts = chunks.join(told.hint("merge"), "chunk").select("chunk", "head", "texts", "told").mapInArrow(_contexts(shards), BLOCKS)
    coded = contexts.groupBy("shard").applyInPandas(_coded, "chunk long, shard int, codes binary, open boolean")
    coded = staged(coded.groupBy("chunk").agg(F.collect_list(F.struct("shard", "codes")).alias("codes"), F.max("open").alias("open")), "substring-codes")
    freed(spark)
    asked = told.join(coded.where("open"), "chunk").select("chunk", "told", "codes")
    tuples = chunks.join(asked.hint("merge"), "chunk").select("chunk", "head", "texts", "told", "codes").mapInArrow(_tuples(shards), BLOCKS)
    # blocks stream through the tasks in order of their shards; a shard is never held as a group
    tasks = max(shards // 4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sorted_blocks = tuples.repartition(tasks, "shard").sortWithinPartitions("shard", "chunk")
    marks = sorted_blocks.mapInPandas(_marks, "chunk long, shard int, at long, marks binary")
    marks = marks.groupBy("chunk").agg(F.collect_list(F.struct("shard", "at", "marks")).alias("marked"))
    hot = told.where(F.exists("told", lambda x: F.length(x["hot"]) > 0))
    later = chunks.join(hot.hint("merge"), "chunk").select("chunk", "head", "texts", "told").mapInArrow(_hot_strings(shards), BLOCKS)
    later = later.groupBy("shard").applyInPandas(_later_strings, "chunk long, block binary").groupBy("chunk").agg(F.collect_list("block").alias("later"))
    decided = told.join(coded.drop("open"), "chunk", "left").join(marks, "chunk", "left").join(later, "chunk", "left")
    decided = staged(decided, "substring-decided")
    freed(spark)
    ready = chunks.join(decided.hint("merge"), "chunk", "left").select("head", "texts", "told", "codes", "marked", "later")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    columns = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return ready.mapInArrow(_results(shards, [*names, "kept"]), columns + ", kept binary") if with_text else ready.mapInArrow(_results(shards, names), columns)
