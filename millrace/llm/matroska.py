"""Media columns: Matroska files written and parsed, without any media library.

A file holds one audio track of 8-bit samples (one byte of payload each, little-endian PCM). Frames of
FRAME bytes are laced LACE to a SimpleBlock, blocks are grouped into clusters, and Cues point at every
cluster. The parser reads any EBML tree: variable-length ids and sizes, sizes left open, blocks in groups,
and all four kinds of lacing. It gives a packet table: track, timestamp, byte range, and what is wrong with a file.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.runtime import small_batches

PAD, FRAME, LACE, CLUSTER_BLOCKS = 64, 256, 8, 15
RATE = 8000  # samples a second
SCALE = 125_000  # nanoseconds of one timestamp unit: one sample

#: Fixed values of the format: element ids.
EBML, SEGMENT, INFO, TRACKS, TRACK, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0x1F43B675, 0x1C53BB6B
VERSION, READ_VERSION, MAX_ID, MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID, AUDIO = 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0xE1
SAMPLING, CHANNELS, BIT_DEPTH, DEFAULT_DURATION = 0xB5, 0x9F, 0x6264, 0x23E383
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Codecs whose frames hold a whole number of uncompressed samples, and the sampling rate where none is named.
PCM, DEFAULT_RATE = ("A_PCM/INT/LIT", "A_PCM/INT/BIG", "A_PCM/FLOAT/IEEE"), 8000.0
_MASTERS = {EBML, SEGMENT, INFO, TRACKS, TRACK, CLUSTER, CUES, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_POSITIONS}
#: Elements that end an open-sized cluster.
_TOP = {SEGMENT, INFO, TRACKS, CLUSTER, CUES}


def vint(value: int, length: int | None = None) -> bytes:
    """A size as variable-length integer; all value bits set is left to mean an open size."""
    n = length or next(n for n in range(1, 9) if value < (1 << 7 * n) - 1)
    return ((1 << 7 * n) | value).to_bytes(n, "big")


def element(tag: int, payload: bytes) -> bytes:
    return tag.to_bytes(-(-tag.bit_length() // 8), "big") + vint(len(payload)) + payload


def number(tag: int, value: int) -> bytes:
    return element(tag, value.to_bytes(max(1, -(-value.bit_length() // 8)), "big"))


def lace_sizes(sizes: list[int]) -> bytes:
    """EBML lacing: the first size, then signed differences; the last size is left out."""
    out = vint(sizes[0])
    for before, size in zip(sizes, sizes[1:-1], strict=False):
        n = next(n for n in range(1, 9) if abs(size - before) < (1 << 7 * n - 1) - 1)
        out += vint(size - before + (1 << 7 * n - 1) - 1, n)
    return out


def block(time: int, frames: list[bytes], track: int = 1) -> bytes:
    sizes = [len(f) for f in frames]
    head = vint(track) + time.to_bytes(2, "big", signed=True)
    if len(frames) == 1:
        return head + b"\x80" + frames[0]
    if len(set(sizes)) == 1:
        return head + b"\x84" + bytes([len(frames) - 1]) + b"".join(frames)
    return head + b"\x86" + bytes([len(frames) - 1]) + lace_sizes(sizes) + b"".join(frames)


def write(payload: bytes) -> bytes:
    """A Matroska file whose packets hold `payload`, byte for byte."""
    frames = [payload[k : k + FRAME] for k in range(0, len(payload), FRAME)]
    head = element(EBML, number(VERSION, 1) + number(READ_VERSION, 1) + number(MAX_ID, 4) + number(MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + number(DOC_VERSION, 4) + number(DOC_READ_VERSION, 2))
    info = element(INFO, number(TIMESTAMP_SCALE, SCALE) + element(DURATION, np.array(len(payload), ">f8").tobytes()) + element(MUXING_APP, b"millrace") + element(WRITING_APP, b"millrace"))
    audio = element(AUDIO, element(SAMPLING, np.array(RATE, ">f8").tobytes()) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    body, at, cues = [info, tracks], len(info) + len(tracks), []
    per = LACE * CLUSTER_BLOCKS
    for first in range(0, len(frames), per):
        blocks = [element(SIMPLE_BLOCK, block((k - first) * FRAME, frames[k : min(k + LACE, first + per)])) for k in range(first, min(first + per, len(frames)), LACE)]
        cluster = element(CLUSTER, number(TIMESTAMP, first * FRAME) + b"".join(blocks))
        cues.append(element(CUE_POINT, number(CUE_TIME, first * FRAME) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    return head + element(SEGMENT, b"".join(body) + element(CUES, b"".join(cues)))


def read_vint(data: bytes, at: int, keep_marker: bool = False, end: int | None = None) -> tuple[int, int, bool]:
    """(value, next position, whether all value bits are set)."""
    end = len(data) if end is None else end
    if at >= end or not data[at]:
        raise ValueError(f"no variable-length integer at byte {at}")
    n = 9 - data[at].bit_length()
    if at + n > end:
        raise ValueError(f"cut off at byte {at}")
    raw = int.from_bytes(data[at : at + n], "big")
    value = raw & ((1 << 7 * n) - 1)
    return (raw if keep_marker else value), at + n, value == (1 << 7 * n) - 1


#: Timestamps below this fit a long, whatever is added within a cluster.
_FAR = 1 << 61


@dataclass
class Media:
    scale: int = 1_000_000  # nanoseconds of one timestamp unit
    tracks: dict[int, dict] = field(default_factory=dict)
    clusters: int = 0
    lacing: list[int] = field(default_factory=lambda: [0, 0, 0, 0])
    packets: list[tuple[int, int | None, int, int]] = field(default_factory=list)  # track, timestamp, first byte, bytes
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time, track, cluster's byte in the segment
    cluster_at: list[int] = field(default_factory=list)
    fault: str | None = None  # what ended the reading before the file's end
    frames: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)  # track, block's time, first byte, bytes; number and bytes before it in its block


def read(data: bytes) -> Media:
    """Parse a file; unknown elements are passed over, damage raises ValueError."""
    media = read_until_damage(data)
    if media.fault:
        raise ValueError(media.fault)
    return media


def read_until_damage(data: bytes) -> Media:
    """Parse a file as far as it is sound; `fault` says what is wrong with it, if anything.

    A frame's timestamp is its block's; frames laced behind it follow by the track's default duration or, for
    uncompressed sound, by the samples before them. Where neither is known they have none.
    """
    media = Media()
    try:
        _walk(data, media)
    except ValueError as error:
        media.fault = str(error)
    for track, time, at, size, number_, before in media.frames:
        own = media.tracks.get(track, {})
        if not number_:
            late = 0.0
        elif own.get("duration"):
            late = number_ * own["duration"] / media.scale
        elif own.get("codec") in PCM and own.get("bits") and own.get("rate", DEFAULT_RATE) > 0:
            late = before * 8e9 / (own["bits"] * own.get("channels", 1) or 1) / own.get("rate", DEFAULT_RATE) / media.scale
        else:
            late = None
        if late is not None and not abs(late) < _FAR:  # a rate or duration beyond all use
            late = None
        media.packets.append((track, None if late is None else time + round(late), at, size))
    media.frames.clear()
    return media


def _walk(data: bytes, media: Media) -> None:
    time, segment, at = 0, 0, 0
    cue, track = [0, 0, 0], {}
    ends: list[tuple[int, int, bool]] = []  # end byte, element, whether its size was left open
    names = {TRACK_NUMBER: "number", TRACK_TYPE: "type", BIT_DEPTH: "bits", CHANNELS: "channels", DEFAULT_DURATION: "duration"}
    while at < len(data):
        while ends and at >= ends[-1][0]:
            _leave(ends.pop()[1], media, cue, track)
        start = at
        tag, at, _ = read_vint(data, at, True)
        size, at, open_size = read_vint(data, at)
        while ends and ends[-1][1] == CLUSTER and ends[-1][2] and tag in _TOP:
            _leave(ends.pop()[1], media, cue, track)
        most = ends[-1][0] if ends else len(data)
        end = most if open_size else at + size
        if end > most:
            raise ValueError(f"element at byte {start} ends after what holds it")
        if tag in _MASTERS:
            ends.append((end, tag, open_size))
            if tag == SEGMENT:
                segment = at
            elif tag == CLUSTER:
                media.clusters += 1
                media.cluster_at.append(start - segment)
            elif tag == TRACK:
                track.clear()
            elif tag == CUE_POINT:
                cue[:] = [0, 0, 0]
            continue
        if open_size:
            raise ValueError(f"element at byte {start} has no size")
        if tag in (SIMPLE_BLOCK, BLOCK):
            _frames(data, at, end, time, media)
        elif tag == CODEC_ID:
            track["codec"] = data[at:end].rstrip(b"\0").decode("ascii", "replace")
        elif tag == SAMPLING and size in (4, 8):
            track["rate"] = struct.unpack(">f" if size == 4 else ">d", data[at:end])[0]
        elif size <= 8:
            value = int.from_bytes(data[at:end], "big")
            if tag == TIMESTAMP:
                if value >= _FAR:
                    raise ValueError(f"cluster time {value} at byte {start}")
                time = value
            elif tag == TIMESTAMP_SCALE:
                if not value:
                    raise ValueError(f"timestamp scale 0 at byte {start}")
                media.scale = value
            elif tag in names:
                track[names[tag]] = value
            elif tag in (CUE_TIME, CUE_TRACK, CUE_CLUSTER):
                cue[(CUE_TIME, CUE_TRACK, CUE_CLUSTER).index(tag)] = value
        at = end
    while ends:
        _leave(ends.pop()[1], media, cue, track)


def _leave(tag: int, media: Media, cue: list[int], track: dict) -> None:
    if tag == CUE_POINT:
        media.cues.append(tuple(cue))
    elif tag == TRACK:
        media.tracks[track.get("number", 0)] = dict(track)


def _frames(data: bytes, at: int, end: int, cluster_time: int, media: Media) -> None:
    """The frames of a block from byte `at` to `end`."""
    start = at

    def byte(k: int) -> int:
        if k >= end:
            raise ValueError(f"block at byte {start} is cut off")
        return data[k]

    track, at, _ = read_vint(data, at, end=end)
    kind = byte(at + 2) >> 1 & 3  # 0 none, 1 Xiph, 2 fixed, 3 EBML
    time = cluster_time + int.from_bytes(data[at : at + 2], "big", signed=True)
    at += 3
    sizes: list[int] = []
    if kind:
        n = byte(at) + 1
        at += 1
        if kind == 1:
            for _ in range(n - 1):
                size = 0
                while byte(at) == 255:
                    size, at = size + 255, at + 1
                sizes.append(size + byte(at))
                at += 1
        elif kind == 3 and n > 1:
            size, at, _ = read_vint(data, at, end=end)
            sizes.append(size)
            for _ in range(n - 2):
                before = at
                step, at, _ = read_vint(data, at, end=end)
                size += step - ((1 << 7 * (at - before) - 1) - 1)
                sizes.append(size)
        elif kind == 2:
            if (end - at) % n:
                raise ValueError(f"fixed lacing of block at byte {start} doesn't fit it")
            sizes = [(end - at) // n] * (n - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError(f"lacing of block at byte {start} doesn't fit it")
    media.lacing[kind] += 1
    first = at
    for k, size in enumerate(sizes):
        media.frames.append((track, time, at, size, k, at - first))
        at += size


def payload_of(text: str | None) -> bytes:
    """UTF-8 with zero bytes up to a positive multiple of PAD."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes(max(PAD, -(-len(data) // PAD) * PAD) - len(data))


def features(media: Media, payload: bytes) -> str:
    """Counts of the container and the loudness of the samples around their middle."""
    x = np.frombuffer(payload or b"\x80", np.uint8).astype(np.float64) - 128
    crossings = int(np.count_nonzero(np.signbit(x[1:]) != np.signbit(x[:-1])))
    cued = sum(c[2] in set(media.cluster_at) for c in media.cues) if len(media.cues) < 2 else len({c[2] for c in media.cues} & set(media.cluster_at))
    return f"tracks={len(media.tracks)};clusters={media.clusters};cues={cued};packets={len(media.packets)};lacing={'/'.join(map(str, media.lacing))};end={max(((p[1] or 0) + p[3] for p in media.packets), default=0)};mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};crossings={crossings}"


def stored(text: Column) -> Column:
    """A text's payload as a Matroska file."""

    @F.pandas_udf("binary")
    def store(texts: pd.Series) -> pd.Series:
        return pd.Series([write(payload_of(t)) for t in texts], dtype=object)

    return store(text)


def packet_table(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """(id, track, timestamp, first_byte, bytes, fault) of every packet of every file; a null file has none.

    Timestamps are in units of the file's scale, null where a laced frame's isn't known. A damaged file gives its
    packets before the damage and one row more that has `fault` alone. An empty file (no byte) has no packets.
    Repeated rows are read each for itself; other columns are not read.
    """
    small_batches(media.sparkSession)

    def packets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, data in zip(batch[id_col], batch[media_col], strict=True):
                found = read_until_damage(data) if data is not None else Media()
                rows = [(*p, None) for p in found.packets] + [(None, None, None, None, found.fault)] * (found.fault is not None)
                for k in range(0, len(rows), 10_000):
                    part = pd.DataFrame(rows[k : k + 10_000], columns=["track", "timestamp", "first_byte", "bytes", "fault"], dtype=object)
                    part.insert(0, id_col, key)
                    yield part

    schema = T.StructType([media.schema[id_col]]).add("track", "long").add("timestamp", "long").add("first_byte", "long").add("bytes", "long").add("fault", "string")
    return media.select(id_col, media_col).mapInPandas(packets, schema)


_DIGEST = T.StructType().add("payload_bytes", "long").add("payload_sha256", "string").add("tail_crc32", "long").add("media_bytes", "long").add("media_sha256", "string").add("feature", "string")


def digest(media: Column) -> Column:
    """What a stored file holds, read back packet by packet; null for a null file.

    Of a damaged file the digest is of what stands before the damage, and `feature` ends with the fault.
    """

    @F.pandas_udf(_DIGEST)
    def digests(files: pd.Series) -> pd.DataFrame:
        rows = []
        for data in files:
            if data is None:
                rows.append((None,) * len(_DIGEST.names))
                continue
            found = read_until_damage(data)
            payload = b"".join(data[at : at + size] for _, _, at, size in found.packets)
            feature = features(found, payload) + (f";fault={found.fault}" if found.fault else "")
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature))
        return pd.DataFrame(rows, columns=_DIGEST.names, dtype=object)

    return digests(media)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media binary) of every row; a null text counts as empty and is stored as PAD zero bytes.

    Equal texts give equal files. Repeated rows are stored each for itself, texts of any length whole.
    """
    small_batches(docs.sparkSession)
    text = F.col(text_col)
    return docs.select(F.col(id_col), F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long")).alias("n_bytes"), stored(text).alias("media"))
