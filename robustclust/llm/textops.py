"""Vectorised byte-level text kernels over Arrow string columns.

Texts stay as one UTF-8 byte array with offsets; words, word hashes, shingle hashes and window hashes are computed for
thousands of texts per call. ASCII whitespace and letters never occur inside a multi-byte UTF-8 sequence, so byte-level
words are the same as code-point-level words.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
PRIME = 0x9E3779B97F4A7C15 | 1
CHUNK = 1 << 20


def column_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    if off is None or not len(col):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32, len(col) + 1 + col.offset)[col.offset :].astype(np.int64)
    base, end = offsets[0], offsets[-1]
    body = np.frombuffer(data, np.uint8)[base:end] if data is not None else np.zeros(0, np.uint8)
    return body, offsets - base


def text_chunks(body: np.ndarray, offsets: np.ndarray, limit: int = CHUNK, rows: int = 2048):
    """Runs of whole texts of about ``limit`` bytes and at most ``rows`` texts: (first row, last row, bytes, offsets from 0)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, i + rows, max(i + 1, j))
        yield i, j, body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    inverse = pow(PRIME, -1, 1 << 64)
    out = []
    for base in (PRIME, inverse):
        p = np.full(n, base, U64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse modulo 2^64."""
    return _powers(max(16, int(n).bit_length()))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer: spreads the low entropy of polynomial hashes over all bits."""
    h = h ^ (h >> U64(31))
    h = h * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


def prefix_hash(body: np.ndarray) -> np.ndarray:
    """Prefix sums of byte * power; any substring hash follows from two of them."""
    up, _ = powers(len(body) + 1)
    out = np.zeros(len(body) + 1, U64)
    np.cumsum((body.astype(U64) + U64(1)) * up[: len(body)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the substrings [start, end)."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start])


def byte_table(member) -> np.ndarray:
    return np.array([bool(member(b)) for b in range(256)])


LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: words of ``[^\x20\x09-\x0D]+``
NOT_SPACE = byte_table(lambda b: not (b == 32 or 9 <= b <= 13))
#: words of letters, digits and everything beyond ASCII
ALNUM = byte_table(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b > 127)


def words(body: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and for each text the index of its first word (one more at the end)."""
    if not len(body):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = member[body]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(body))]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets).astype(np.int64)


def word_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, prefix: np.ndarray | None = None) -> np.ndarray:
    return span_hash(prefix_hash(body) if prefix is None else prefix, starts, ends)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive word hashes (also across texts; the caller slices by text)."""
    if len(h) < k:
        return np.zeros(0, U64)
    n = len(h) - k + 1
    acc = np.zeros(n, U64)
    for j in range(k):
        acc = acc * U64(0xF1357AEA2E62A9C5) + h[j : j + n]
    return mix(acc)


def row_of(offsets: np.ndarray) -> np.ndarray:
    """The row index of each element of a ragged array."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def cumulative(values: np.ndarray, dtype=np.int64) -> np.ndarray:
    out = np.zeros(len(values) + 1, dtype)
    np.cumsum(values, out=out[1:])
    return out


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = cumulative(values)
    return total[offsets[1:]] - total[offsets[:-1]]
