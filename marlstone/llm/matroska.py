"""Matroska media columns: EBML elements to packet tables, and back.

The reader walks variable-length EBML elements through Segment and Clusters
(known or unknown sizes), splits blocks by their lacing (none, Xiph, fixed-size,
EBML) and returns packets with timestamps, tracks and byte ranges, and the cue
points. The writer stores samples losslessly as an 8-bit PCM track of laced
blocks, so that texts make a round trip.

Defined cases: null or empty media has no packets; media that breaks off or
isn't Matroska gives the packets before the damage and a non-null ``error``; a
null or empty text is stored as one frame of padding; repeated rows are handled
each; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import reach_workers

FRAME = 576
PAD = 255
TAIL = 32
RATE = 8000
#: Frames laced into a block, and blocks in a cluster, by the writer.
LACED, BLOCKS = 8, 32

# Element ids of the format.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
SCALE, DURATION, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC = 0x2AD7B1, 0x4489, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
DEFAULT_DURATION, AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Elements that end a cluster of unknown size.
TOP = frozenset({SEGMENT, INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469})
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3


class Damaged(ValueError):
    """The bytes don't go on as the format demands."""


def vint(data: bytes, at: int, marker: bool = False) -> tuple[int, int]:
    """Value and length; the length marker stays in ids. All ones: -1."""
    if at >= len(data) or not data[at]:
        raise Damaged(f"no variable-length number at byte {at}")
    n = 9 - data[at].bit_length()
    if at + n > len(data):
        raise Damaged(f"number at byte {at} is cut off")
    value = int.from_bytes(data[at : at + n], "big")
    if marker:
        return value, n
    value &= (1 << 7 * n) - 1
    return (-1 if value == (1 << 7 * n) - 1 else value), n


def elements(data: bytes, at: int, end: int):
    """``(id, body, end)`` of the elements in a range; an unknown size runs to
    the range's end."""
    while at < end:
        name, n = vint(data, at, marker=True)
        size, m = vint(data, at + n)
        body = at + n + m
        stop = end if size < 0 else body + size
        if stop > end:
            raise Damaged(f"element {name:X} at byte {at} is cut off")
        yield name, body, stop, size < 0
        at = stop


def _uint(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def laced(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """Byte ranges of a block's frames."""
    if kind == NO_LACING:
        return [(at, end)]
    if at >= end:
        raise Damaged(f"no frame count at byte {at}")
    count = data[at] + 1
    at += 1
    if kind == FIXED:
        if (end - at) % count:
            raise Damaged(f"{end - at} bytes don't make {count} equal frames")
        size = (end - at) // count
        return [(at + i * size, at + (i + 1) * size) for i in range(count)]
    sizes = []
    for i in range(count - 1):
        if kind == XIPH:
            size = 0
            while True:
                if at >= end:
                    raise Damaged("frame sizes are cut off")
                size += data[at]
                at += 1
                if data[at - 1] != 255:
                    break
        else:
            value, n = vint(data, at)
            if i:  # a difference, biased by half the range
                value = (value if value >= 0 else (1 << 7 * n) - 1) - ((1 << (7 * n - 1)) - 1)
                value += sizes[-1]
            size, at = value, at + n
        sizes.append(size)
    edges = [at]
    for size in sizes:
        edges.append(edges[-1] + size)
    if edges[-1] > end or min(sizes, default=0) < 0:
        raise Damaged("frame sizes exceed the block")
    return list(zip(edges, [*edges[1:], end]))


def read(data: bytes | None) -> dict:
    """``tracks``, ``packets``, ``cues``, ``scale``, ``duration``, ``error``.

    A packet: ``(track, time in ns, cluster, block, frame, offset, size, key)``."""
    out = {"tracks": {}, "packets": [], "cues": [], "scale": 1_000_000, "duration": None, "error": None}
    if not data:
        return out
    try:
        if vint(data, 0, marker=True)[0] != EBML:
            raise Damaged("no EBML header")
        for name, a, b, _ in elements(data, 0, len(data)):
            if name == SEGMENT:
                _segment(data, a, b, out)
    except Damaged as e:
        out["error"] = str(e)
    return out


def _segment(data: bytes, at: int, end: int, out: dict) -> None:
    clusters, first = 0, at
    while at < end:
        for name, a, b, unknown in elements(data, at, end):
            break
        if name == INFO:
            for x, c, d, _ in elements(data, a, b):
                if x == SCALE:
                    out["scale"] = _uint(data, c, d)
                elif x == DURATION:
                    out["duration"] = struct.unpack(">f" if d - c == 4 else ">d", data[c:d])[0]
        elif name == TRACKS:
            for x, c, d, _ in elements(data, a, b):
                if x == TRACK_ENTRY:
                    _track(data, c, d, out)
        elif name == CLUSTER:
            b = _cluster(data, a, b, unknown, clusters, out)
            clusters += 1
        elif name == CUES:
            for x, c, d, _ in elements(data, a, b):
                if x == CUE_POINT:
                    _cue(data, c, d, first, out)
        at = b


def _track(data: bytes, at: int, end: int, out: dict) -> None:
    track = {"number": 0, "codec": "", "default_duration": 0}
    for name, a, b, _ in elements(data, at, end):
        if name == TRACK_NUMBER:
            track["number"] = _uint(data, a, b)
        elif name == CODEC:
            track["codec"] = data[a:b].decode("ascii", "replace")
        elif name == DEFAULT_DURATION:
            track["default_duration"] = _uint(data, a, b)
    out["tracks"][track["number"]] = track


def _cue(data: bytes, at: int, end: int, base: int, out: dict) -> None:
    time, found = 0, []
    for name, a, b, _ in elements(data, at, end):
        if name == CUE_TIME:
            time = _uint(data, a, b)
        elif name == CUE_POSITIONS:
            got = {x: _uint(data, c, d) for x, c, d, _ in elements(data, a, b)}
            found.append((got.get(CUE_TRACK, 0), base + got.get(CUE_CLUSTER, 0)))
    out["cues"] += [(track, time * out["scale"], offset) for track, offset in found]


def _cluster(data: bytes, at: int, end: int, unknown: bool, number: int, out: dict) -> int:
    """Adds the packets; returns where the cluster ends."""
    time, block = 0, 0
    while at < end:
        if unknown and vint(data, at, marker=True)[0] in TOP:
            return at
        for name, a, b, _ in elements(data, at, end):
            break
        if name == TIMESTAMP:
            time = _uint(data, a, b)
        elif name == SIMPLE_BLOCK:
            _block(data, a, b, time, number, block, data[a + vint(data, a)[1] + 2] & 0x80 != 0, out)
            block += 1
        elif name == BLOCK_GROUP:
            inner = [(x, c, d) for x, c, d, _ in elements(data, a, b)]
            key = all(x != REFERENCE for x, _, _ in inner)
            for x, c, d in inner:
                if x == BLOCK:
                    _block(data, c, d, time, number, block, key, out)
                    block += 1
        at = b
    return at


def _block(data: bytes, at: int, end: int, time: int, cluster: int, block: int, key: bool, out: dict) -> None:
    track, n = vint(data, at)
    if at + n + 3 > end:
        raise Damaged(f"block at byte {at} is cut off")
    relative = int.from_bytes(data[at + n : at + n + 2], "big", signed=True)
    kind = data[at + n + 2] >> 1 & 3
    step = out["tracks"].get(track, {}).get("default_duration", 0)
    start = (time + relative) * out["scale"]
    for i, (a, b) in enumerate(laced(data, at + n + 3, end, kind)):
        out["packets"].append((track, start + i * step, cluster, block, i, a, b - a, key))


def size_vint(value: int, least: int = 1) -> bytes:
    n = least
    while value >= (1 << 7 * n) - 1:
        n += 1
    return (value | 1 << 7 * n).to_bytes(n, "big")


def element(name: int, body: bytes) -> bytes:
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + size_vint(len(body)) + body


def number(name: int, value: int) -> bytes:
    return element(name, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], kind: int) -> bytes:
    if kind == NO_LACING:
        (frame,) = frames
        return frame
    sizes = [len(f) for f in frames]
    head = bytes([len(frames) - 1])
    if kind == XIPH:
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif kind == EBML_LACING and len(sizes) > 1:
        head += size_vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            n = 1
            while not -((1 << (7 * n - 1)) - 1) < b - a < (1 << (7 * n - 1)) - 1:
                n += 1
            head += (b - a + (1 << (7 * n - 1)) - 1 | 1 << 7 * n).to_bytes(n, "big")
    return head + b"".join(frames)


_HEAD = element(EBML, number(0x4286, 1) + number(0x42F7, 1) + number(0x42F2, 4) + number(0x42F3, 8) + element(0x4282, b"matroska") + number(0x4287, 4) + number(0x4285, 2))


def write(payload: bytes, frame: int = FRAME, kind: int = FIXED) -> bytes:
    """Payload (a multiple of ``frame``) as 8-bit PCM of one channel."""
    ms = frame * 1000 // RATE
    track = element(
        TRACK_ENTRY,
        number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + element(CODEC, b"A_PCM/INT/LIT")
        + number(DEFAULT_DURATION, ms * 1_000_000)
        + element(AUDIO, element(SAMPLING, struct.pack(">d", RATE)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8)),
    )
    total = len(payload) // frame
    info = element(INFO, number(SCALE, 1_000_000) + element(DURATION, struct.pack(">d", total * ms)))
    body = [info, element(TRACKS, track)]
    at, cues = sum(map(len, body)), []
    per_block = 1 if kind == NO_LACING else LACED
    for first in range(0, total, per_block * BLOCKS):
        blocks = [number(TIMESTAMP, first * ms)]
        for b in range(first, min(first + per_block * BLOCKS, total), per_block):
            frames = [payload[i * frame : (i + 1) * frame] for i in range(b, min(b + per_block, total))]
            head = b"\x81" + ((b - first) * ms).to_bytes(2, "big", signed=True) + bytes([0x80 | kind << 1])
            blocks.append(element(SIMPLE_BLOCK, head + lace(frames, kind)))
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(CUE_POINT, number(CUE_TIME, first * ms) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    body.append(element(CUES, b"".join(cues)))
    return _HEAD + element(SEGMENT, b"".join(body))


def padded(text: str | None, frame: int = FRAME) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(1, -(-len(raw) // frame)) * frame, bytes([PAD]))


def features(payload: bytes, got: dict) -> str:
    """Clusters, packets, end in ms, mean sample, sample deviation, zero crossings
    and the share of cues that point at a cluster."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    last = got["packets"][-1]
    end = (last[1] + got["tracks"][last[0]]["default_duration"]) // 1_000_000
    mean = int(x.sum())
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    power = int((x * x).sum())
    return f"clusters={last[2] + 1};packets={len(got['packets'])};ms={end};sum={mean};power={power};crossings={crossings};cues={len(got['cues'])}"


def stored(docs: DataFrame) -> DataFrame:
    """Texts through the format and back: ``doc_id, n_bytes, payload_bytes,
    payload_sha256, tail_crc32, media_bytes, media_sha256, feature``."""

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                payload = padded(text)
                media = write(payload)
                got = read(media)
                if got["error"]:
                    raise Damaged(got["error"])
                back = b"".join([media[p[5] : p[5] + p[6]] for p in got["packets"]])
                rows.append(
                    (len((text or "").encode("utf-8", "surrogatepass")), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-TAIL:]), len(media), hashlib.sha256(media).hexdigest(), features(back, got))
                )
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    reach_workers(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    )


def packets(media: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """One row per packet: id, ``track, time_ns, cluster, block, frame, offset,
    size, key, error``; media that is damaged has a last row with the error."""
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
    names = ["track", "time_ns", "cluster", "block", "frame", "offset", "size", "key"]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                got = read(batch.column(1)[i].as_py())
                rows = [(*p, None) for p in got["packets"]] + [(None,) * 8 + (got["error"],)] * (got["error"] is not None)
                for at in range(0, len(rows), 20_000):
                    part = rows[at : at + 20_000]
                    ids = batch.column(0).take(pa.array([i] * len(part), pa.int32()))
                    cols = [pa.array([r[k] for r in part], t) for k, t in enumerate((*kinds, pa.string()))]
                    yield pa.RecordBatch.from_arrays([ids, *cols], ["id", *names, "error"])

    reach_workers(media.sparkSession)
    kind = media.schema[id_col].dataType.simpleString()
    return media.select(id_col, media_col).mapInArrow(
        run, f"id {kind}, track bigint, time_ns bigint, cluster int, block int, frame int, offset bigint, size bigint, key boolean, error string"
    )
