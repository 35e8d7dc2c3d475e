"""Motion-JPEG in AVI: RIFF indexes, intra frames, shots by adaptive histogram differences.

``parse`` walks the RIFF chunks and takes the frames from the ``idx1`` index (or, without one, from the ``movi``
list). ``decode_jpeg`` decodes baseline sequential JPEG: marker segments, Huffman codes, dequantisation, inverse
transform. A cut is where the histogram difference of two neighbouring frames exceeds the mean by three standard
deviations of the last ``WINDOW`` differences; ``clips`` gives timed rows.

``store`` writes any bytes losslessly: a payload byte is one flat 8 by 8 tile of a grey frame of 16 by 12 tiles, that
is an intra block with a DC coefficient only, and the quantiser 8 makes the tile's value exact. Its Huffman tables give
every DC difference of category c a code of 9 - c bits, so that each takes 9 bits, and the end of a block one bit:
frames of this fixed layout are coded and decoded as arrays, all others by the general decoder. Any JPEG decoder
reads the same samples.

Defined results: null and empty texts are one frame of blanks; equal texts give equal media and features; a
payload with a multiple of 192 bytes is not padded; damaged media raise ValueError in ``parse`` and ``decode_jpeg``,
and give no clip rows in ``clips``; repeated rows give repeated results; further columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from faultline.llm.common import map_text, narrow

TILES_X, TILES_Y, FPS, WINDOW, BINS = 16, 12, 25, 24, 16
FRAME = TILES_X * TILES_Y
ZIGZAG = np.array([int(x) for x in """0 1 8 16 9 2 3 10 17 24 32 25 18 11 4 5 12 19 26 33 40 48 41 34 27 20 13 6 7 14 21 28 35 42 49 56 57 50 43 36 29 22 15
 23 30 37 44 51 58 59 52 45 38 31 39 46 53 60 61 54 47 55 62 63""".split()])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


# category c has a code of 9 - c bits: canonical order is by length, so categories 8, 7, ... 0
_DHT = _segment(0xC4, bytes([0x00, *([1] * 9), *([0] * 7), *range(8, -1, -1)])) + _segment(0xC4, bytes([0x10, 1, *([0] * 15), 0]))
_HEAD = b"\xff\xd8" + _segment(0xDB, bytes([0, *([8] * 64)])) + _segment(0xC0, struct.pack(">BHHBBBB", 8, TILES_Y * 8, TILES_X * 8, 1, 1, 0x11, 0)) + _DHT + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
_TAIL = b"\xff\xd9"


def _codes() -> tuple[np.ndarray, np.ndarray]:
    """Ten bits of each difference -255 to 255 (its code, its bits, the end of the block), and the way back."""
    to, back, code = np.zeros(511, np.uint64), np.full(1024, -999, np.int16), 0
    prefix = {}
    for length in range(1, 10):
        prefix[9 - length] = code
        code = (code + 1) << 1
    for d in range(-255, 256):
        c = abs(d).bit_length()
        bits = (prefix[c] << c | (d if d > 0 else d + (1 << c) - 1)) << 1
        to[d + 255], back[bits] = bits, d
    return to, back


_CODE, _VALUE = _codes()


def _frames(samples: np.ndarray) -> list[bytes]:
    """The JPEG images of an (n, FRAME) array of samples."""
    shifted = samples.astype(np.int16) - 128
    diff = np.diff(shifted, axis=1, prepend=np.int16(0))
    codes = _CODE[diff + 255].reshape(-1, 4)
    packed = (codes[:, 0] << np.uint64(30)) | (codes[:, 1] << np.uint64(20)) | (codes[:, 2] << np.uint64(10)) | codes[:, 3]
    raw = packed.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()
    size = FRAME * 10 // 8
    stuffed = [raw[i : i + size] for i in range(0, len(raw), size)]
    if b"\xff" in raw:
        stuffed = [x.replace(b"\xff", b"\xff\x00") for x in stuffed]
    return [b"".join((_HEAD, x, _TAIL)) for x in stuffed]


def store(payload: bytes) -> bytes:
    """An AVI file whose frames hold ``payload``, of a positive multiple of FRAME bytes."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, FRAME)
    movi, index, at = [b"movi"], [], 4
    for i in range(0, len(samples), 4096):
        for image in _frames(samples[i : i + 4096]):
            size = len(image)
            movi.append(b"00dc" + size.to_bytes(4, "little") + image + b"\0" * (size & 1))
            index.append(struct.pack("<4sIII", b"00dc", 16, at, size))
            at += 8 + size + (size & 1)
    width, height, n = TILES_X * 8, TILES_Y * 8, len(samples)
    avih = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, n, 0, 1, 0, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, n, 0, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    strl = _list(b"strl", _chunk(b"strh", strh) + _chunk(b"strf", strf))
    body = b"".join([b"AVI ", _list(b"hdrl", _chunk(b"avih", avih) + strl), b"LIST", at.to_bytes(4, "little"), *movi, _chunk(b"idx1", b"".join(index))])
    return _chunk(b"RIFF", body)


def _chunk(name: bytes, body: bytes) -> bytes:
    return b"".join((name, len(body).to_bytes(4, "little"), body, b"\0" * (len(body) & 1)))


def _list(name: bytes, body: bytes) -> bytes:
    return _chunk(b"LIST", name + body)


def parse(media: bytes) -> tuple[float, list[tuple[int, int]]]:
    """Frames a second, and the place and size of each frame."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    fps, frames, index, movi = float(FPS), [], None, None
    stack = [(12, min(len(media), 8 + int.from_bytes(media[4:8], "little")))]
    while stack:
        at, end = stack.pop()
        while at + 8 <= end:
            name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
            body = at + 8
            if body + size > len(media):
                raise ValueError("a chunk ends behind the file")
            if name == b"LIST":
                kind = media[body : body + 4]
                if kind == b"movi":
                    movi = body
                    if index is None:
                        frames_at = (body + 4, body + size)
                elif kind in (b"hdrl", b"strl"):
                    stack.append((body + 4, body + size))
            elif name == b"strh" and media[body : body + 4] == b"vids":
                scale, rate = struct.unpack_from("<II", media, body + 20)
                fps = rate / scale if scale and rate else fps
            elif name == b"idx1":
                index = media[body : body + size]
            at = body + size + (size & 1)
    if movi is None:
        raise ValueError("no frames")
    if index:
        entries = np.frombuffer(index[: len(index) // 16 * 16], dtype="<u4").reshape(-1, 4)
        kinds = entries[:, 0] >> 16
        entries = entries[(kinds == int.from_bytes(b"dc", "little")) | (kinds == int.from_bytes(b"db", "little"))]
        base = movi
        if len(entries) and media[movi + int(entries[0, 2]) : movi + int(entries[0, 2]) + 4] != entries[0, 0].astype("<u4").tobytes():
            base = 0  # some writers count from the file's start
        frames = [(base + 8 + a, s) for a, s in zip(entries[:, 2].tolist(), entries[:, 3].tolist())]
        if any(a + s > len(media) for a, s in frames):
            raise ValueError("an index entry points behind the file")
    else:
        at, end = frames_at
        while at + 8 <= end:
            name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
            if name[2:] in (b"dc", b"db"):
                frames.append((at + 8, size))
            at += 8 + size + (size & 1)
    return fps, frames


class _Bits:
    """Bits of entropy-coded data, without its stuffing."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def take(self, n: int) -> int:
        while self.n < n:
            self.held = self.held << 8 | (self.data[self.at] if self.at < len(self.data) else 0xFF)
            if self.at > len(self.data) + 8:
                raise ValueError("the image ends too early")
            self.at += 1
            self.n += 8
        self.n -= n
        out = self.held >> self.n
        self.held &= (1 << self.n) - 1
        return out

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in table:
                return table[length, code]
        raise ValueError("no such code")

    def value(self, size: int) -> int:
        v = self.take(size) if size else 0
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


_k, _x = np.meshgrid(np.arange(8), np.arange(8))
_COSINES = np.cos((2 * _x + 1) * _k * np.pi / 16) * np.where(_k == 0, np.sqrt(0.125), 0.5)


def decode_jpeg(image: bytes) -> np.ndarray:
    """(height, width, components) samples of a baseline image, in its own colour space; chroma is repeated."""
    if image[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG image")
    at, quant, huffman, frame, restart, scan = 2, {}, {}, None, 0, None
    while at + 4 <= len(image):
        if image[at] != 0xFF:
            raise ValueError("a marker was expected")
        marker, size = image[at + 1], int.from_bytes(image[at + 2 : at + 4], "big")
        body = image[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide, k = body[0] >> 4, body[0] & 15
                quant[k] = np.frombuffer(body[1 : 1 + 64 * (1 + wide)], dtype=">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                counts, values, code, table, used = body[1:17], body[17:], 0, {}, 0
                for length, c in enumerate(counts, 1):
                    for _ in range(c):
                        table[length, code] = values[used]
                        code, used = code + 1, used + 1
                    code <<= 1
                huffman[body[0]] = table
                body = body[17 + used :]
        elif marker in (0xC0, 0xC1):
            height, width = struct.unpack(">HH", body[1:5])
            frame = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline images are decoded")
        elif marker == 0xDD:
            restart = int.from_bytes(body, "big")
        elif marker == 0xDA:
            scan = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            break
    if frame is None or scan is None:
        raise ValueError("no image data")
    end = image.rfind(b"\xff\xd9")
    coded = image[at : end if end >= at else len(image)]
    parts, begin, i = [], 0, coded.find(b"\xff")
    while i >= 0 and i + 1 < len(coded):
        if 0xD0 <= coded[i + 1] <= 0xD7:
            parts.append(coded[begin:i])
            begin = i + 2
        i = coded.find(b"\xff", i + 2)
    parts.append(coded[begin:])
    streams = iter([_Bits(x.replace(b"\xff\x00", b"\xff")) for x in parts])
    top_h, top_v = max(f[1] for f in frame), max(f[2] for f in frame)
    if len(frame) == 1:
        frame = [(frame[0][0], 1, 1, frame[0][3])]
        top_h = top_v = 1
    across, down = -(-width // (8 * top_h)), -(-height // (8 * top_v))
    planes = [np.zeros((down * v * 8, across * h * 8)) for _, h, v, _ in frame]
    bits, last = next(streams), [0] * len(frame)
    for mcu in range(across * down):
        if restart and mcu and mcu % restart == 0:
            bits, last = next(streams), [0] * len(frame)
        for k, (name, h, v, q) in enumerate(frame):
            dc, ac = huffman[scan[name] >> 4], huffman[16 | scan[name] & 15]
            for block in range(h * v):
                coefficients = np.zeros(64, np.int64)
                last[k] += bits.value(bits.symbol(dc))
                coefficients[0], i = last[k], 1
                while i < 64:
                    s = bits.symbol(ac)
                    if s == 0:
                        break
                    i += s >> 4
                    if s & 15 and i < 64:
                        coefficients[i] = bits.value(s & 15)
                    i += 1
                natural = np.zeros(64)
                natural[ZIGZAG] = coefficients * quant[q]
                y, x = (mcu // across * v + block // h) * 8, (mcu % across * h + block % h) * 8
                planes[k][y : y + 8, x : x + 8] = _COSINES @ natural.reshape(8, 8) @ _COSINES.T
    out = [np.repeat(np.repeat(p, top_v // v, axis=0), top_h // h, axis=1)[:height, :width] for p, (_, h, v, _) in zip(planes, frame)]
    return np.clip(np.rint(np.stack(out, axis=-1) + 128), 0, 255).astype(np.uint8)


def samples_of(media: bytes) -> Iterator[np.ndarray]:
    """The samples of frames in turn, as (frames, samples) arrays: those of the fixed layout one of each tile."""
    _, frames = parse(media)
    size, held = FRAME * 10 // 8, []
    head, tail, start = _HEAD, _TAIL, len(_HEAD)
    for at, length in frames:
        image = media[at : at + length]
        if image.startswith(head) and image.endswith(tail):
            coded = image[start:-2]
            if len(coded) != size:
                coded = coded.replace(b"\xff\x00", b"\xff")
            if len(coded) == size:
                held.append(coded)
                if len(held) == 4096:
                    yield _tiles(held)
                    held = []
                continue
        if held:
            yield _tiles(held)
            held = []
        yield decode_jpeg(image)[..., 0].reshape(1, -1)
    if held:
        yield _tiles(held)


def _tiles(coded: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(coded), np.uint8).reshape(-1, 5).astype(np.uint64)
    word = raw[:, 0] << np.uint64(32) | raw[:, 1] << np.uint64(24) | raw[:, 2] << np.uint64(16) | raw[:, 3] << np.uint64(8) | raw[:, 4]
    fields = np.stack([word >> np.uint64(s) & np.uint64(1023) for s in (30, 20, 10, 0)], axis=1)
    diff = _VALUE[fields.astype(np.int64)].reshape(len(coded), FRAME)
    values = np.cumsum(diff, axis=1, dtype=np.int32) + 128
    if values.min() < 0 or values.max() > 255:
        raise ValueError("a sample is out of range")
    return values.astype(np.uint8)


def histograms(samples: np.ndarray) -> np.ndarray:
    """Shares of BINS equal ranges of brightness, a row for each frame."""
    n, m = samples.shape
    at = (samples.astype(np.int64) * BINS >> 8) + np.arange(n)[:, None] * BINS
    return np.bincount(at.ravel(), minlength=n * BINS).reshape(n, BINS) / m


def cuts(hist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames at which a shot begins, the differences): a cut exceeds mean + 3 deviations of the last differences."""
    diff = np.abs(np.diff(hist, axis=0)).sum(axis=1)
    n = len(diff)
    total, square = np.r_[0, np.cumsum(diff)], np.r_[0, np.cumsum(diff**2)]
    low = np.maximum(np.arange(n) - WINDOW, 0)
    count = np.arange(n) - low
    some = np.maximum(count, 1)
    mean = (total[:n] - total[low]) / some
    spread = np.sqrt(np.maximum((square[:n] - square[low]) / some - mean**2, 0))
    at = np.flatnonzero((count >= 4) & (diff > mean + 3 * spread) & (diff > 0.1)) + 1
    return at, diff


def describe(hist: np.ndarray) -> str:
    at, diff = cuts(hist)
    brightness = float((hist.mean(axis=0) * (np.arange(BINS) + 0.5)).sum() / BINS)
    return f"frames={len(hist)};shots={len(at) + 1};first_cut={at[0] if len(at) else -1};mean_diff={diff.mean() if len(diff) else 0:.6f};max_diff={diff.max() if len(diff) else 0:.6f};brightness={brightness:.6f}"


def clips(df: DataFrame, id_col: str = "media_id", media_col: str = "media") -> DataFrame:
    """id, clip, start_s, end_s, frames: the shots of every file; null and damaged files have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[], [], [], [], []]
            for i, media in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    fps = parse(media)[0] if media else 1.0
                    parts = [histograms(x) for x in samples_of(media)] if media else []
                except (ValueError, KeyError, IndexError, StopIteration, struct.error):
                    continue
                if parts:
                    hist = np.concatenate(parts)
                    edges = [0, *cuts(hist)[0].tolist(), len(hist)]
                    for k, (a, z) in enumerate(zip(edges, edges[1:])):
                        for column, v in zip(rows, (i, k, a / fps, z / fps, z - a)):
                            column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.float64()), pa.array(rows[3], pa.float64()), pa.array(rows[4], pa.int64())], ["id", "clip", "start_s", "end_s", "frames"])

    return narrow(df, id_col, media_col).mapInArrow(run, "id long, clip int, start_s double, end_s double, frames long").withColumnRenamed("id", id_col)


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (max(1, -(-len(raw) // FRAME)) * FRAME - len(raw)), len(raw)


def stored(df: DataFrame) -> DataFrame:
    """doc_id, media: every text as an AVI file."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([store(payload_of(t)[0]) for t in b.column(1).to_pylist()], pa.binary())], ["doc_id", "media"])

    return map_text(narrow(df, "doc_id", "text"), run, "doc_id long, media binary")


def digests(df: DataFrame) -> DataFrame:
    """doc_id and what is read back of every text's file: sizes, check sums, feature."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(7)]
        for text in b.column(1).to_pylist():
            payload, n = payload_of(text)
            media = store(payload)
            sha, size, end, hist = hashlib.sha256(), 0, b"", []
            for samples in samples_of(media):
                back = samples.tobytes()
                sha.update(back)
                size += len(back)
                end = (end + back)[-16:]
                hist.append(histograms(samples))
            for column, v in zip(out, (n, size, sha.hexdigest(), zlib.crc32(end), len(media), hashlib.sha256(media).hexdigest(), describe(np.concatenate(hist)))):
                column.append(v)
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(out, kinds)]], names)

    return map_text(narrow(df, "doc_id", "text"), run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
