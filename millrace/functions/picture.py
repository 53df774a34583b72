"""Perceptual hashes of pictures: PNG files to grey values, grey values to the signs of their lowest frequencies."""

from __future__ import annotations

import struct
import zlib
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Side of the hash, and of the small picture that it is taken from.
SIDE, SMALL = 8, 32
#: Weights of red, green and blue in a grey value, in 65536ths.
GREY = (19595, 38470, 7471)
_HEAD = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: First column and row, and steps, of the seven passes of an interlaced picture.
_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
#: Pixels beyond which a file is taken for damaged, so that a small file can't ask for all memory.
MOST_PIXELS = 1 << 26


class PictureError(ValueError):
    """No picture that can be read; the message says why."""


def _chunks(data: bytes):
    if data[:8] != _HEAD:
        raise PictureError("no PNG")
    at = 8
    while at + 12 <= len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(body) < size or at + 12 + size > len(data):
            raise PictureError("cut off")
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise PictureError(f"chunk {kind!r} is damaged")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + size
    raise PictureError("cut off")


def _unfiltered(raw: bytes, rows: int, width: int, step: int) -> np.ndarray:
    """Bytes of rows whose filters are undone. `width`: bytes of a row, `step`: bytes to the pixel on the left."""
    out = np.zeros((rows, width), np.uint8)
    above = np.zeros(width, np.uint8)
    for y in range(rows):
        kind, line = raw[y * (width + 1)], np.frombuffer(raw, np.uint8, width, y * (width + 1) + 1)
        if kind == 0:
            own = line.copy()
        elif kind == 2:
            own = line + above
        elif kind == 1:  # running sums, one for each byte of a pixel
            own = np.concatenate([np.zeros(0, np.uint8), line])
            for k in range(min(step, width)):
                own[k::step] = np.cumsum(line[k::step], dtype=np.uint64).astype(np.uint8)
        elif kind in (3, 4):
            own = np.array(_by_neighbours(line.tolist(), above.tolist(), step, kind), np.uint8)
        else:
            raise PictureError(f"filter {kind}")
        out[y] = above = own
    return out


def _by_neighbours(line: list[int], above: list[int], step: int, kind: int) -> list[int]:
    own: list[int] = []
    for k, x in enumerate(line):
        left, corner = (own[k - step], above[k - step]) if k >= step else (0, 0)
        up = above[k]
        if kind == 3:
            guess = (left + up) // 2
        else:  # the neighbour nearest to left + up - corner
            p = left + up - corner
            guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
        own.append((x + guess) & 255)
    return own


def _samples(rows: np.ndarray, width: int, channels: int, depth: int) -> np.ndarray:
    """[row, column, channel] as numbers of `depth` bits."""
    if depth == 16:
        return rows.reshape(len(rows), width, channels, 2).astype(np.uint16)[..., 0] * 256 + rows.reshape(len(rows), width, channels, 2)[..., 1]
    if depth == 8:
        return rows.reshape(len(rows), width, channels).astype(np.uint16)
    bits = np.unpackbits(rows, axis=1)[:, : width * depth].reshape(len(rows), width, depth)
    return (bits * (1 << np.arange(depth - 1, -1, -1))).sum(2, dtype=np.uint16)[..., None]


def grey_of(data: bytes) -> np.ndarray:
    """Grey values 0 to 255 of a PNG file, alpha left out; PictureError where it is none or damaged."""
    head, palette, body = None, None, []
    for kind, own in _chunks(data):
        if kind == b"IHDR":
            if len(own) != 13:
                raise PictureError("header")
            head = struct.unpack(">IIBBBBB", own)
        elif kind == b"PLTE":
            palette = np.frombuffer(own[: len(own) // 3 * 3], np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(own)
    if head is None:
        raise PictureError("no header")
    width, height, depth, colour, _, _, laced = head
    if not width or not height or width * height > MOST_PIXELS or colour not in _CHANNELS or depth not in (1, 2, 4, 8, 16) or (depth < 8 and colour not in (0, 3)) or laced > 1:
        raise PictureError(f"{width} x {height}, {depth} bits of kind {colour}")
    channels = _CHANNELS[colour]
    places = [p for p in _PASSES if p[0] < width and p[1] < height] if laced else [(0, 0, 1, 1)]
    sizes = [(-(-(width - x) // dx), -(-(height - y) // dy)) for x, y, dx, dy in places]
    lengths = [h * (1 + -(-w * channels * depth // 8)) for w, h in sizes]
    try:
        raw = zlib.decompressobj().decompress(b"".join(body), sum(lengths) + 1)
    except zlib.error as error:
        raise PictureError(str(error)) from None
    if len(raw) < sum(lengths):
        raise PictureError("too few rows")
    picture, at = np.zeros((height, width, channels), np.uint16), 0
    for (x, y, dx, dy), (w, h), n in zip(places, sizes, lengths, strict=True):
        rows = _unfiltered(raw[at : at + n], h, n // h - 1, max(1, channels * depth // 8))
        picture[y::dy, x::dx] = _samples(rows, w, channels, depth)
        at += n
    if colour == 3:
        if palette is None or picture.max() >= len(palette):
            raise PictureError("palette")
        colours = palette[picture[..., 0]].astype(np.int64)
    else:
        scaled = picture >> 8 if depth == 16 else picture * (255 // ((1 << depth) - 1))
        colours = (scaled[..., :3] if channels > 2 else np.repeat(scaled[..., :1], 3, 2)).astype(np.int64)
    return (colours @ np.array(GREY) + 0x8000) >> 16


@cache
def _resampler(size: int, small: int = SMALL) -> np.ndarray:
    """[small, size] weights of a windowed sinc of three lobes, widened where the picture shrinks."""
    scale = size / small
    reach = max(scale, 1.0)
    at = (np.arange(small) + 0.5) * scale
    x = (np.arange(size)[None, :] + 0.5 - at[:, None]) / reach
    weights = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
    return weights / weights.sum(1, keepdims=True)


@cache
def _cosines(n: int = SMALL, rows: int = SIDE) -> np.ndarray:
    k, x = np.arange(rows)[:, None], np.arange(n)[None, :]
    return 2 * np.cos(np.pi * k * (2 * x + 1) / (2 * n))


def code_of(grey: np.ndarray) -> int:
    """64 bits, signed: which of the lowest 8 x 8 frequencies are above their median, row by row, the first one highest."""
    height, width = grey.shape
    across = np.clip(np.floor(grey @ _resampler(width).T + 0.5), 0, 255)
    small = np.clip(np.floor(_resampler(height) @ across + 0.5), 0, 255)
    low = _cosines() @ small @ _cosines().T
    bits = (low > np.median(low)).ravel()
    code = int.from_bytes(np.packbits(bits).tobytes(), "big")
    return code - (1 << 64) if code >> 63 else code


def coded(picture: Column) -> Column:
    """struct(code, problem) of a picture file; a null file has neither, a damaged one only its problem."""

    @F.pandas_udf("code long, problem string")
    def one(files: pd.Series) -> pd.DataFrame:
        out = []
        for data in files:
            try:
                out.append((None if data is None else code_of(grey_of(bytes(data))), None))
            except PictureError as error:
                out.append((None, str(error)))
        return pd.DataFrame(out, columns=["code", "problem"], dtype=object)

    return one(picture)


def png(grey: np.ndarray) -> bytes:
    """A picture of grey values as a PNG file."""
    height, width = grey.shape
    rows = np.concatenate([np.zeros((height, 1), np.uint8), grey.astype(np.uint8)], 1).tobytes()

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return _HEAD + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 1)) + chunk(b"IEND", b"")


def drawn(text: Column, columns: int = 64) -> Column:
    """A text's UTF-8 bytes as grey values, `columns` a row, in a PNG file; null and empty texts give one black row."""

    @F.pandas_udf("binary")
    def one(texts: pd.Series) -> pd.Series:
        def picture(t: str | None) -> bytes:
            raw = (t or "").encode("utf-8", "surrogatepass") or b"\0"
            return png(np.frombuffer(raw + bytes(-len(raw) % columns), np.uint8).reshape(-1, columns))

        return pd.Series([picture(t) for t in texts], dtype=object)

    return one(text)
