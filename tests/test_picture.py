"""PNG files and perceptual hashes: every kind and filter against a plain reading, copies near, damage told."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import picture
from millrace.plans import registry_calls

SF = "/root/testdata/sf0.001"


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def filtered(rows, step, kinds):
    """Plain PNG filters, byte by byte."""
    out, above = b"", [0] * len(rows[0])
    for y, row in enumerate(rows):
        kind, line = kinds[y % len(kinds)], []
        for k, x in enumerate(row):
            a, b, c = row[k - step] if k >= step else 0, above[k], above[k - step] if k >= step else 0
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            line.append((x - (0, a, b, (a + b) // 2, paeth)[kind]) & 255)
        out += bytes([kind, *line])
        above = row
    return out


def written(samples, depth, colour, kinds=(0, 1, 2, 3, 4), laced=False, palette=None):
    """samples: [row][column] of tuples."""
    h, w = len(samples), len(samples[0])
    channels = len(samples[0][0])
    body = b""
    for x0, y0, dx, dy in picture._PASSES if laced else ((0, 0, 1, 1),):
        part = [row[x0::dx] for row in samples[y0::dy]]
        if not part or not part[0]:
            continue
        rows = []
        for row in part:
            bits = "".join(f"{v:0{depth}b}" for px in row for v in px)
            bits += "0" * (-len(bits) % 8)
            rows.append([int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)])
        body += filtered(rows, max(1, channels * depth // 8), kinds)
    more = chunk(b"PLTE", bytes(palette)) if palette is not None else b""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, int(laced))) + more + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("laced", [False, True])
@pytest.mark.parametrize(("depth", "colour"), [(1, 0), (2, 0), (4, 0), (8, 0), (16, 0), (8, 2), (16, 2), (1, 3), (4, 3), (8, 3), (8, 4), (16, 4), (8, 6), (16, 6)])
def test_every_kind(depth, colour, laced):
    rng = np.random.default_rng(depth * 10 + colour)
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    palette = rng.integers(0, 256, 3 * (1 << min(depth, 8))).tolist() if colour == 3 else None
    samples = [[tuple(int(v) for v in rng.integers(0, 1 << depth, channels)) for _ in range(11)] for _ in range(13)]
    got = picture.grey_of(written(samples, depth, colour, laced=laced, palette=palette))

    def grey(px):
        if colour == 3:
            r, g, b = palette[3 * px[0] : 3 * px[0] + 3]
        else:
            eight = [v >> 8 if depth == 16 else v * 255 // ((1 << depth) - 1) for v in px]
            r, g, b = eight[:3] if channels > 2 else [eight[0]] * 3
        return (r * 19595 + g * 38470 + b * 7471 + 0x8000) >> 16

    assert got.tolist() == [[grey(px) for px in row] for row in samples]


def waves(seed, h=96, w=120):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:1:h * 1j, 0:1:w * 1j]
    out = sum(rng.normal() * np.cos(np.pi * (a * x + b * y) + rng.normal()) for a in range(6) for b in range(6))
    return np.clip(128 + 40 * out / np.abs(out).mean() / 2, 0, 255).astype(np.uint8)


def test_copies_are_near_and_others_are_not():
    bits = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    codes = [picture.code_of(waves(k)) for k in range(12)]
    for k in range(12):
        own = waves(k)
        brighter = np.clip(own * 0.8 + 30, 0, 255)
        smaller = own[: 96 // 2 * 2, : 120 // 2 * 2].reshape(48, 2, 60, 2).mean((1, 3))
        larger = np.repeat(np.repeat(own, 2, 0), 2, 1)
        assert all(bits(codes[k], picture.code_of(np.asarray(x))) <= 8 for x in (brighter, smaller, larger))
    assert min(bits(a, b) for i, a in enumerate(codes) for b in codes[:i]) > 12


def test_code_is_the_sign_of_frequencies():
    """Against the sums of the definition, on a picture that needs no resizing."""
    own = waves(5, 32, 32).astype(float)
    n = np.arange(32)
    low = np.array([[4 * (own * np.outer(np.cos(np.pi * u * (2 * n + 1) / 64), np.cos(np.pi * v * (2 * n + 1) / 64))).sum() for v in range(8)] for u in range(8)])
    want = int("".join("1" if x > np.median(low) else "0" for x in low.ravel()), 2)
    assert picture.code_of(own) & (1 << 64) - 1 == want


def test_damage_is_told(spark):
    good = picture.png(waves(1))
    head = bytearray(good)
    head[20] ^= 1
    huge = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1 << 20, 1 << 20, 8, 0, 0, 0, 0)) + chunk(b"IEND", b"")
    files = [(1, good), (2, None), (3, b""), (4, good[:-9]), (5, bytes(head)), (6, huge), (7, b"GIF89a"), (8, written([[(0,)]], 8, 0, kinds=(0,))[:-12]), (9, written([[(3,)]], 8, 3, palette=[1, 2, 3]))]
    got = {r["k"]: r["c"] for r in spark.createDataFrame(files, "k int, f binary").select("k", picture.coded(F.col("f")).alias("c")).collect()}
    assert got[1]["code"] is not None and got[1]["problem"] is None and (got[2]["code"], got[2]["problem"]) == (None, None)
    assert all(got[k]["code"] is None and got[k]["problem"] for k in range(3, 10))


def test_query_against_brute_force(spark):
    rows = {r["doc_id"]: r for r in registry_calls.QUERIES["picture_dedup"](spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    kept = {}
    for k in sorted(texts):
        raw = (texts[k] or "").encode() or b"\0"
        code = picture.code_of(np.frombuffer(raw + bytes(-len(raw) % 64), np.uint8).reshape(-1, 64).astype(np.int64))
        near = min((((code ^ c) & (1 << 64) - 1).bit_count(), j) for j, c in kept.items()) if kept else (99, None)
        want = (code, "near_image", near[1], near[0]) if near[0] <= 8 else (code, "unique", None, None)
        assert tuple(rows[k])[1:] == want
        if want[1] == "unique":
            kept[k] = code
    assert 0 < sum(r["kind"] == "near_image" for r in rows.values()) < len(rows)
