"""Media columns: payloads as AVI motion-JPEG, decoded by its index, with shots found by adaptive histogram differences.

A payload byte is stored as one quantised DCT coefficient (the unit of the format): 64 coefficients a block, three
components a 192-byte unit, up to 32 units a frame. Frames are baseline JPEG images: code words follow from the Huffman
tables in their headers by the canonical rule, for writing and for reading. The tables written give a coefficient of
size s a code of ``WORD_BITS`` - s bits, so that every word is equally long and both directions are array operations;
quantisation steps of 1 keep it lossless. Images of any other tables, sampling, number of components or restart
intervals are decoded word by word.

Defined results: a null or empty text is one unit of padding; identical texts (repeated rows, ties) give identical media;
an empty table gives no rows; a text of any length is stored whole; a null media value gives no clips; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from robustclust.llm.session import light_batches
from robustclust.llm.textops import column_bytes, text_chunks

UNIT = 192
UNITS_PER_FRAME = 32
FRAME_MS = 40
#: fixed value: the zigzag order of an 8 x 8 block
ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
#: every code word written, DC or AC, has this many bits, so four of them fill five bytes
WORD_BITS = 10


def _table(kind: int, longest_size: int, least_size: int) -> bytes:
    """A Huffman table in the header's form: one code a length, the larger sizes the shorter codes."""
    sizes = list(range(longest_size, least_size - 1, -1))
    counts = [0] * 16
    for size in sizes:
        counts[WORD_BITS - size - 1] = 1
    return bytes([kind, *counts, *sizes])


#: the tables written: differences of DC coefficients have up to 9 bits, AC coefficients 1 to 8 and no runs
TABLES = _table(0x00, 9, 0) + _table(0x10, 8, 1)


def read_tables(body: bytes) -> dict[int, dict[int, tuple[int, int]]]:
    """For each table of a header segment the (code, bits) of its symbols: codes count up, doubled at each length."""
    out, at = {}, 0
    while at < len(body):
        counts = body[at + 1 : at + 17]
        symbols = iter(body[at + 17 : at + 17 + sum(counts)])
        code, words = 0, {}
        for bits, n in enumerate(counts, 1):
            for _ in range(n):
                words[next(symbols)] = (code, bits)
                code += 1
            code <<= 1
        out[body[at]] = words
        at += 17 + sum(counts)
    return out


def code_word(words: dict[int, tuple[int, int]], value: int) -> tuple[int, int]:
    """(word, bits) of a coefficient without a run before it: its size's code, then its low bits."""
    size = abs(value).bit_length()
    code, bits = words[size]
    return code << size | (value if value > 0 else value + (1 << size) - 1), bits + size


#: bytes to non-zero coefficients, code words of bytes and of DC differences, and bytes again
COEFFICIENT = np.array([b - 128 if b < 128 else b - 127 for b in range(256)], np.int16)
AC_WORD = np.array([code_word(read_tables(TABLES)[0x10], int(v))[0] for v in COEFFICIENT], np.int64)
DC_WORD = np.array([code_word(read_tables(TABLES)[0x00], d)[0] for d in range(-256, 257)], np.int64)
TO_BYTE = np.array([v + 128 if v < 0 else v + 127 for v in range(-128, 129)], np.int16).astype(np.uint8)


def _dct_matrix() -> np.ndarray:
    """Rows: coefficients in zigzag order; columns: the 64 samples they add up to."""
    x = np.arange(8)
    basis = np.array([[np.cos((2 * i + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for i in x] for u in x])
    return np.array([np.outer(basis[z // 8], basis[z % 8]).ravel() for z in ZIGZAG], np.float32)


INVERSE_DCT = _dct_matrix()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def jpeg_head(units: int) -> bytes:
    frame = struct.pack(">BHHB", 8, 8, 8 * units, 3) + bytes([1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0])
    return (
        b"\xff\xd8"
        + _segment(0xDB, b"\0" + b"\1" * 64)
        + _segment(0xC0, frame)
        + _segment(0xC4, TABLES)
        + _segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))
    )


def encode_frames(payload: np.ndarray, units: int) -> list[bytes]:
    """JPEG images of ``units`` units each; ``payload`` is a whole number of frames."""
    blocks = payload.reshape(-1, units, 3, 64)
    code = AC_WORD[blocks]
    code[..., 0] = DC_WORD[np.diff(COEFFICIENT[blocks[..., 0]], axis=1, prepend=np.int16(0)) + 256]
    four = code.reshape(len(blocks), -1, 4)
    value = four[..., 0] << 30 | four[..., 1] << 20 | four[..., 2] << 10 | four[..., 3]
    packed = np.ascontiguousarray(value.astype(">i8").view(np.uint8).reshape(len(blocks), -1, 8)[..., 3:])
    head = jpeg_head(units)
    return [head + row.tobytes().replace(b"\xff", b"\xff\0") + b"\xff\xd9" for row in packed]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def encode_avi(payload: bytes | np.ndarray) -> bytes:
    """An AVI file of a payload whose length is a positive multiple of 192."""
    data = np.frombuffer(payload, np.uint8) if isinstance(payload, (bytes, bytearray)) else payload
    total = len(data) // UNIT
    units = min(total, UNITS_PER_FRAME)
    if pad := -total % units * UNIT:
        data = np.concatenate([data, np.full(pad, 32, np.uint8)])
    images = encode_frames(data, units)
    width, most = 8 * units, max(map(len, images))
    avih = struct.pack("<14I", FRAME_MS * 1000, 0, 0, 0x10, len(images), 0, 1, most, width, 8, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, FRAME_MS, 1000, 0, len(images), most, 0xFFFFFFFF, 0, 0, 0, width, 8)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, 8, 1, 24, b"MJPG", width * 24, 0, 0, 0, 0)
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"payload=%d\0" % (total * UNIT)))
    movi, index, at = [b"movi"], [], 4
    for image in images:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(image)))
        movi.append(chunk := _chunk(b"00dc", image))
        at += len(chunk)
    body = b"AVI " + header + info + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def _chunks(raw: bytes, at: int, end: int):
    """(name, start, end) of the chunks between two offsets; lists are entered by the caller."""
    while at + 8 <= end:
        name, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        yield name, at + 8, at + 8 + size
        at += 8 + size + size % 2


class Movie(NamedTuple):
    #: extents of the frames by the file's index, the payload's length if the file states one, and the frames' duration
    extents: list[tuple[int, int]]
    length: int | None
    frame_ms: float


def parse_avi(raw: bytes) -> Movie:
    if raw[:4] != b"RIFF" or raw[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movi, index, length, frame_ms = None, None, None, float(FRAME_MS)
    for name, start, end in _chunks(raw, 12, len(raw)):
        kind = raw[start : start + 4] if name == b"LIST" else b""
        if kind == b"movi":
            movi = (start, end)
        elif kind == b"hdrl":
            frame_ms = next((struct.unpack_from("<I", raw, s)[0] / 1000 for n, s, _ in _chunks(raw, start + 4, end) if n == b"avih"), frame_ms)
        elif kind == b"INFO":
            said = next((raw[s:e].rstrip(b"\0") for n, s, e in _chunks(raw, start + 4, end) if n == b"ICMT"), b"")
            length = int(said[8:]) if said.startswith(b"payload=") else None
        elif name == b"idx1":
            index = (start, end)
    if movi is None or index is None:
        raise ValueError("an AVI file without frames or index")
    entries = [struct.unpack_from("<4sIII", raw, at) for at in range(index[0], index[1] - 15, 16)]
    frames = [(name, offset, size) for name, _, offset, size in entries if name[2:] in (b"dc", b"db")]
    # offsets count from the list of frames or, in some files, from the beginning
    base = movi[0] if not frames or raw[movi[0] + frames[0][1] :][:4] == frames[0][0] else 0
    return Movie([(base + offset + 8, base + offset + 8 + size) for _, offset, size in frames], length, frame_ms)


class Image(NamedTuple):
    """A baseline image's header: components are (id, across, down, quantisation, DC table, AC table)."""

    width: int
    height: int
    components: tuple[tuple[int, int, int, int, int, int], ...]
    steps: dict[int, tuple[int, ...]]
    tables: bytes
    restart: int
    data: int


def read_image(raw: bytes, start: int) -> Image:
    if raw[start : start + 2] != b"\xff\xd8":
        raise ValueError("not a JPEG image")
    at, frame, steps, tables, restart = start + 2, None, {}, b"", 0
    while True:
        marker, size = raw[at + 1], struct.unpack_from(">H", raw, at + 2)[0]
        body = raw[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                steps[body[k] & 15] = struct.unpack_from(">64H" if wide else ">64B", body, k + 1)
                k += 65 + 64 * bool(wide)
        elif marker in (0xC0, 0xC1):
            bits, height, width, n = struct.unpack_from(">BHHB", body)
            if bits != 8:
                raise ValueError("samples of other than 8 bits")
            frame = (width, height, [tuple(body[6 + 3 * i : 9 + 3 * i]) for i in range(n)])
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline image")
        elif marker == 0xC4:
            tables += body
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            if frame is None or not tables:
                raise ValueError("an image without a frame header or Huffman tables")
            chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            if len(chosen) != len(frame[2]):
                raise ValueError("components in scans of their own")
            parts = tuple((c, hv >> 4, hv & 15, q, chosen[c] >> 4, 0x10 | chosen[c] & 15) for c, hv, q in frame[2])
            return Image(frame[0], frame[1], parts, steps, tables, restart, at)


@lru_cache(maxsize=64)
def _even_words(tables: bytes, dc: int, ac: int) -> tuple[int, np.ndarray, np.ndarray] | None:
    """(bits, DC differences, AC coefficients by word) where all words are equally long and none is a run; else None."""
    read = read_tables(tables)
    lengths = {bits + size for size, (_, bits) in [*read[dc].items(), *read[ac].items()]}
    if len(lengths) != 1 or max(read[ac]) > 15 or 0 in read[ac] or (width := lengths.pop()) not in (5, 8, 10):
        return None
    out = []
    for words in (read[dc], read[ac]):
        table = np.zeros(1 << width, np.int16)
        for size in words:
            for value in {v for k in range(1 << size >> 1, 1 << size) for v in (k, -k)}:
                table[code_word(words, value)[0]] = value
        out.append(table)
    return width, *out


def _scan_words(image: Image, raw: bytes) -> list[np.ndarray]:
    """The coefficients of each component, decoded word by word, in the order of the blocks in the scan."""
    read = {k: {(bits, code): symbol for symbol, (code, bits) in words.items()} for k, words in read_tables(image.tables).items()}
    across, down = max(c[1] for c in image.components), max(c[2] for c in image.components)
    alone = len(image.components) == 1
    units = -(-image.width // (8 if alone else 8 * across)) * -(-image.height // (8 if alone else 8 * down))
    parts, at = [], 0
    for found in re.finditer(rb"\xff[\xd0-\xd7]", raw):
        parts.append(raw[at : found.start()])
        at = found.end()
    parts.append(raw[at:])
    out: list[list[list[int]]] = [[] for _ in image.components]
    for number, part in enumerate(parts):
        stream = part.replace(b"\xff\0", b"\xff")
        value, left, place = 0, 0, 0

        def take(n: int) -> int:
            nonlocal value, left, place
            while left < n:
                value, left, place = value << 8 | (stream[place] if place < len(stream) else 255), left + 8, place + 1  # noqa: B023
            left -= n
            got, value = value >> left, value & (1 << left) - 1
            return got

        def symbol(words: dict) -> int:
            code = 0
            for bits in range(1, 17):
                code = code << 1 | take(1)
                if (bits, code) in words:
                    return words[bits, code]
            raise ValueError("a code that is in no table")

        def extended(size: int) -> int:
            got = take(size) if size else 0
            return got if not size or got >> size - 1 else got - (1 << size) + 1

        before = [0] * len(image.components)
        count = min(image.restart, units - number * image.restart) if image.restart else units
        for _ in range(count):
            for c, (_, h, v, _, dc, ac) in enumerate(image.components):
                for _ in range(1 if alone else h * v):
                    block = [0] * 64
                    before[c] += extended(symbol(read[dc]))
                    block[0], k = before[c], 1
                    while k < 64:
                        run, size = divmod(symbol(read[ac]), 16)
                        if not size and run != 15:
                            break
                        k += run
                        if size:
                            block[k] = extended(size)
                        k += 1
                    out[c].append(block)
    return [np.array(x, np.int16).reshape(-1, 64) for x in out]


def decode_images(raw: bytes, extents: list[tuple[int, int]]) -> list[tuple[Image, list[np.ndarray]]]:
    """For each frame its header and, for each component, the quantised coefficients of its blocks in zigzag order."""
    images = [read_image(raw, start) for start, _ in extents]
    out, same = [], {}
    for i, (image, (_, end)) in enumerate(zip(images, extents, strict=True)):
        kinds = {c[4:] for c in image.components}
        plain = len(kinds) == 1 and not image.restart and all(c[1:3] == (1, 1) for c in image.components)
        even = _even_words(image.tables, *next(iter(kinds))) if plain else None
        data = raw[image.data : raw.rindex(b"\xff\xd9", image.data, end)]
        if even is None:
            out.append((image, _scan_words(image, data)))
        else:
            out.append((image, []))
            same.setdefault((image[:3], image.tables, even[0]), []).append((i, even, data.replace(b"\xff\0", b"\xff")))
    for (header, _, width), rows in same.items():
        n, units = len(header[2]), -(-header[0] // 8) * -(-header[1] // 8)
        need = -(-units * n * 64 * width // 40) * 5
        packed = np.frombuffer(b"".join(data.ljust(need, b"\xff")[:need] for _, _, data in rows), np.uint8).reshape(-1, 5)
        wide = np.zeros((len(packed), 8), np.uint8)
        wide[:, 3:] = packed
        value, each = wide.view(">i8").ravel().astype(np.int64), 40 // width
        words = np.empty((len(value), each), np.int32)
        for k in range(each):
            words[:, k] = value >> (40 - width * (k + 1)) & (1 << width) - 1
        words = words.reshape(len(rows), -1)[:, : units * n * 64].reshape(len(rows), units, n, 64)
        _, dc, ac = rows[0][1]
        blocks = ac[words]
        blocks[..., 0] = np.cumsum(dc[words[..., 0]], axis=1)
        for (i, _, _), b in zip(rows, blocks, strict=True):
            out[i] = (out[i][0], [b[:, c] for c in range(n)])
    return out


def payload_of(images: list[tuple[Image, list[np.ndarray]]]) -> np.ndarray:
    """The bytes that the coefficients stand for, with the padding of the last frame."""
    return np.concatenate([TO_BYTE[np.stack(parts, axis=1) + 128].ravel() for _, parts in images])


def luma_histograms(images: list[tuple[Image, list[np.ndarray]]], bins: int = 16) -> np.ndarray:
    """For each frame the shares of its luma samples by brightness."""
    steps = [np.array(image.steps.get(image.components[0][3], (1,) * 64), np.float32) for image, _ in images]
    sizes = np.array([len(parts[0]) for _, parts in images])
    luma = np.concatenate([parts[0] * step for (_, parts), step in zip(images, steps, strict=True)]).astype(np.float32) @ INVERSE_DCT + 128
    level = np.clip(luma, 0, 255).astype(np.int64) * bins // 256
    frame = np.repeat(np.arange(len(images)), sizes)
    counts = np.bincount((level + frame[:, None] * bins).ravel(), minlength=len(images) * bins).reshape(len(images), bins)
    return counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)


def shot_starts(histograms: np.ndarray, window: int = 8, spread: float = 3.0, least: float = 0.12) -> list[int]:
    """First frames of the shots: a cut where the difference stands out from those of the frames before it."""
    diff = np.abs(np.diff(histograms, axis=0)).sum(axis=1) / 2
    starts = [0]
    for t, d in enumerate(diff):
        past = diff[max(0, t - window) : t]
        limit = max(least, past.mean() + spread * past.std()) if len(past) else least
        if d > limit:
            starts.append(t + 1)
    return starts


def padded(raw: bytes) -> bytes:
    return raw + b" " * (-len(raw) % UNIT or (0 if raw else UNIT))


def _clip_rows(media: bytes) -> list[tuple[int, int, int, int, int]]:
    movie = parse_avi(media)
    if not movie.extents:
        return []
    starts = [*shot_starts(luma_histograms(decode_images(media, movie.extents))), len(movie.extents)]
    at = lambda frame: round(frame * movie.frame_ms)
    return [(i, a, b - 1, at(a), at(b)) for i, (a, b) in enumerate(zip(starts, starts[1:], strict=False))]


def _encode(batches):
    for batch in batches:
        body, offsets = column_bytes(batch.column(1))
        media = [encode_avi(padded(body[a:b].tobytes())) for a, b in zip(offsets, offsets[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], names=["doc_id", "media"])


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, media: each text as an AVI file."""
    return light_batches(docs).select("doc_id", "text").mapInArrow(_encode, f"doc_id {dict(docs.dtypes)['doc_id']}, media binary")


def _clips(batches):
    for batch in batches:
        rows = [(i, *clip) for i, media in enumerate(batch.column(1).to_pylist()) if media is not None for clip in _clip_rows(media)]
        at = pa.array([r[0] for r in rows], pa.int64())
        columns = [pa.array([r[k] for r in rows], pa.int32() if k < 4 else pa.int64()) for k in range(1, 6)]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *columns], names=["doc_id", "clip", "first_frame", "last_frame", "start_ms", "end_ms"])


def clips(media: DataFrame) -> DataFrame:
    """doc_id, clip, first_frame, last_frame, start_ms, end_ms of a (doc_id, media) table."""
    return media.select("doc_id", "media").mapInArrow(_clips, f"doc_id {dict(media.dtypes)['doc_id']}, clip int, first_frame int, last_frame int, start_ms long, end_ms long")


def digest_of(raw: bytes) -> tuple[int, int, str, int, int, str, str]:
    """Store, read back and describe one text: the digest columns after doc_id."""
    media = encode_avi(padded(raw))
    movie = parse_avi(media)
    images = decode_images(media, movie.extents)
    payload = payload_of(images)[: movie.length].tobytes()
    starts = shot_starts(luma_histograms(images))
    feature = f"frames={len(movie.extents)};shots={len(starts)};starts_ms=" + ",".join(str(s * FRAME_MS) for s in starts)
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature


def _digest(batches):
    for batch in batches:
        body, offsets = column_bytes(batch.column(1))
        rows = [digest_of(part[a:b].tobytes()) for _, _, part, off in text_chunks(body, offsets) for a, b in zip(off, off[1:], strict=False)]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names=["doc_id", *names])


def digest(docs: DataFrame) -> DataFrame:
    """One row a document: lengths and hashes of payload and media as read back, and the shots found."""
    return light_batches(docs).select("doc_id", "text").mapInArrow(
        _digest,
        f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )
