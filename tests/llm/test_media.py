import hashlib
import zlib

import numpy as np
import pytest

from robustclust.llm import media

from .conftest import ODD


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 6143, 6144, 6145, 30000, 3_000_000])
def test_lossless(n):
    raw = np.random.default_rng(n).integers(0, 256, n).astype(np.uint8).tobytes()
    movie = media.encode_avi(media.padded(raw))
    extents, length, frame_ms = media.parse_avi(movie)
    images = media.decode_images(movie, extents)
    assert media.payload_of(images)[:length].tobytes() == media.padded(raw) and len(media.padded(raw)) % 192 == 0 < length
    assert all(movie[s : s + 2] == b"\xff\xd8" and movie[e - 2 : e] == b"\xff\xd9" for s, e in extents)
    assert len(images) == len(extents) and frame_ms == 40


def segments(image):
    """(marker, body) of the segments up to the scan, and the entropy-coded bytes."""
    at, out = 2, []
    while True:
        marker, size = image[at + 1], int.from_bytes(image[at + 2 : at + 4], "big")
        out.append((marker, image[at + 4 : at + 2 + size]))
        at += 2 + size
        if marker == 0xDA:
            return out, image[at:-2].replace(b"\xff\0", b"\xff")


def codes(body):
    """Bit strings of each table's symbols: the next code of a length is the last one plus one, with zeros appended."""
    tables = {}
    while body:
        counts, symbols, n = body[1:17], body[17:], 0
        code, tables[body[0]] = -1, {}
        length = 0
        for bits in range(1, 17):
            for _ in range(counts[bits - 1]):
                code = (code + 1) << (bits - length) if length else 0
                length = bits
                tables[body[0]][f"{code:0{bits}b}"] = symbols[n]
                n += 1
        body = symbols[n:]
    return tables


def read_bits(bits, pos, table):
    for n in range(1, 17):
        if bits[pos : pos + n] in table:
            return table[bits[pos : pos + n]], pos + n
    raise AssertionError("no code")


def test_frames_are_baseline_images():
    """A decoder of its own, bit by bit with the tables in the header, reads the same coefficients."""
    raw = np.random.default_rng(5).integers(0, 256, 192 * 5).astype(np.uint8).tobytes()
    movie = media.encode_avi(raw)
    (start, end), *_ = media.parse_avi(movie).extents
    parts, data = segments(movie[start:end])
    head = dict(parts)
    assert head[0xC0] == bytes([8, 0, 8, 0, 40, 3, 1, 17, 0, 2, 17, 0, 3, 17, 0]) and head[0xDB] == b"\0" + b"\1" * 64
    tables, bits = codes(head[0xC4]), "".join(f"{b:08b}" for b in data)
    got, before, pos = [], [0, 0, 0], 0
    for block in range(15):
        k = 0
        while k < 64:
            symbol, pos = read_bits(bits, pos, tables[0x10 if k else 0x00])
            run, size = symbol >> 4, symbol & 15
            assert not run
            extra, pos = int(bits[pos : pos + size] or "0", 2), pos + size
            value = extra if not size or extra >> size - 1 else extra - (1 << size) + 1
            if not k:
                before[block % 3] += value
                value = before[block % 3]
            got.append(value)
            k += 1
    assert pos == len(bits) and got == media.COEFFICIENT[np.frombuffer(raw, np.uint8)].tolist()


def foreign_image(width, height, sampling, restart, seed):
    """An image of other tables, runs, ends of blocks, sampling and restarts, written bit by bit; and its coefficients."""
    rng = np.random.default_rng(seed)
    dc_sizes, ac_symbols = list(range(12)), [0x00, 0xF0, *(r << 4 | s for r in range(16) for s in range(1, 4))]
    rng.shuffle(ac_symbols)
    tables = {0x01: (bytes([0, 0, 0, 12, *[0] * 12]), dc_sizes), 0x12: (bytes([0] * 5 + [len(ac_symbols)] + [0] * 10), ac_symbols)}
    dht = b"".join(bytes([k]) + c + bytes(v) for k, (c, v) in tables.items())
    word = {k: {s: b for b, s in t.items()} for k, t in codes(dht).items()}
    n = len(sampling)
    across, down = max(h for h, _ in sampling), max(v for _, v in sampling)
    alone = n == 1
    units = -(-width // (8 if alone else 8 * across)) * -(-height // (8 if alone else 8 * down))
    out, data, bits, before, marker = [[] for _ in range(n)], b"", "", [0] * n, 0

    def low(value):
        size = abs(value).bit_length()
        return size, f"{value if value > 0 else value + (1 << size) - 1:0{size}b}" if size else ""

    def closed(bits):
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")

    for unit in range(units):
        if restart and unit and unit % restart == 0:
            data += closed(bits) + bytes([0xFF, 0xD0 + marker % 8])
            bits, before, marker = "", [0] * n, marker + 1
        for c, (h, v) in enumerate(sampling):
            for _ in range(1 if alone else h * v):
                block = np.where(rng.random(64) < 0.06, rng.integers(-7, 8, 64), 0)
                block[0] = rng.integers(-200, 200)
                size, tail = low(int(block[0]) - before[c])
                before[c] = int(block[0])
                bits += word[0x01][size] + tail
                run = 0
                for x in block[1:].tolist():
                    if not x:
                        run += 1
                        continue
                    while run > 15:
                        bits += word[0x12][0xF0]
                        run -= 16
                    size, tail = low(x)
                    bits += word[0x12][run << 4 | size] + tail
                    run = 0
                if run:
                    bits += word[0x12][0x00]
                out[c].append(block.tolist())
    data += closed(bits)
    seg = lambda m, body: bytes([0xFF, m]) + (len(body) + 2).to_bytes(2, "big") + body
    sof = bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([n]) + b"".join(bytes([c + 1, h << 4 | v, 0]) for c, (h, v) in enumerate(sampling))
    sos = bytes([n]) + b"".join(bytes([c + 1, 0x12]) for c in range(n)) + bytes([0, 63, 0])
    head = b"\xff\xd8" + seg(0xE0, b"JFIF\0rest") + seg(0xDB, b"\0" + bytes(range(1, 65))) + seg(0xC0, sof) + seg(0xC4, dht)
    return head + (seg(0xDD, restart.to_bytes(2, "big")) if restart else b"") + seg(0xDA, sos) + data + b"\xff\xd9", out


@pytest.mark.parametrize(("width", "height", "sampling", "restart"), [(17, 9, [(1, 1)], 0), (40, 16, [(1, 1)] * 3, 0), (33, 20, [(2, 2), (1, 1), (1, 1)], 0), (64, 8, [(2, 1), (1, 1), (1, 1)], 3), (24, 24, [(1, 1)] * 4, 2)])
def test_other_images_are_decoded(width, height, sampling, restart):
    for seed in range(6):
        image, want = foreign_image(width, height, sampling, restart, seed)
        ((head, got),) = media.decode_images(b"lead" + image, [(4, 4 + len(image))])
        assert (head.width, head.height) == (width, height) and [x.tolist() for x in got] == want
        assert media.luma_histograms([(head, got)]).sum() == pytest.approx(1)


def test_what_cannot_be_decoded_is_refused():
    movie = media.encode_avi(media.padded(b"x"))
    (start, end), *_ = media.parse_avi(movie).extents
    image = movie[start:end]
    with pytest.raises(ValueError):
        media.read_image(image.replace(b"\xff\xc0", b"\xff\xc2"), 0)
    with pytest.raises(ValueError):
        media.read_image(b"no image at all", 0)


def test_digest(documents):
    rows = media.digest(documents(ODD)).collect()
    assert len(rows) == len(ODD)
    by_text = {}
    for r in rows:
        text = next(t for i, t in ODD if i == r["doc_id"])
        raw = (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        same = (r["media_sha256"], r["media_bytes"], r["feature"])
        assert by_text.setdefault(text or "", same) == same
    assert media.digest(documents([])).count() == 0


def test_shots_and_clips(documents):
    flat, busy = b" " * 6144, bytes(range(192)) * 32
    movie = media.encode_avi(flat * 10 + busy * 10)
    images = media.decode_images(movie, media.parse_avi(movie).extents)
    assert media.shot_starts(media.luma_histograms(images)) == [0, 10]
    docs = documents([(1, "a" * 61440 + "".join(chr(32 + i % 90) for i in range(61440))), (2, None)])
    rows = media.clips(media.encode(docs)).orderBy("doc_id", "clip").collect()
    assert [(r["first_frame"], r["last_frame"], r["start_ms"], r["end_ms"]) for r in rows if r["doc_id"] == 1] == [(0, 9, 0, 400), (10, 19, 400, 800)]
    assert len([r for r in rows if r["doc_id"] == 2]) == 1


def test_foreign_files_are_refused():
    with pytest.raises(ValueError):
        media.parse_avi(b"RIFF\0\0\0\0WAVE")
