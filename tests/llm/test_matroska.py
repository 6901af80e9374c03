import hashlib
import random
import zlib

import pytest

from marlstone.llm import matroska as mk


@pytest.mark.parametrize("kind", [mk.NO_LACING, mk.XIPH, mk.FIXED, mk.EBML_LACING])
@pytest.mark.parametrize("frames", [1, 7, 8, 9, 300])
def test_round_trip(kind, frames):
    payload = random.Random(frames).randbytes(frames * mk.FRAME)
    media = mk.write(payload, kind=kind)
    got = mk.read(media)
    assert got["error"] is None
    assert b"".join(media[p[5] : p[5] + p[6]] for p in got["packets"]) == payload
    assert [p[1] for p in got["packets"]] == [i * 72_000_000 for i in range(frames)]
    for _, time, offset in got["cues"]:
        assert media[offset : offset + 4] == mk.CLUSTER.to_bytes(4, "big")
        assert time in {p[1] for p in got["packets"]}


@pytest.mark.parametrize("kind", [mk.XIPH, mk.EBML_LACING])
def test_uneven_lacing(kind):
    rnd = random.Random(5)
    frames = [rnd.randbytes(rnd.choice([0, 1, 254, 255, 256, 600, 20_000, 3])) for _ in range(40)]
    data = mk.lace(frames, kind)
    assert [data[a:b] for a, b in mk.laced(data, 0, len(data), kind)] == frames


def test_numbers():
    for v in (0, 1, 126, 127, 128, 16382, 16383, 2**21, 2**40):
        assert mk.vint(mk.size_vint(v), 0) == (v, len(mk.size_vint(v)))
    assert mk.vint(b"\x01" + b"\xff" * 7, 0) == (-1, 8)
    for bad in (b"", b"\x00\x01", b"\x40"):
        with pytest.raises(mk.Damaged):
            mk.vint(bad, 0)


def test_unknown_sizes_and_block_groups():
    unknown = b"\x01" + b"\xff" * 7
    block = b"\x81\x00\x05\x00" + b"abc"
    group = mk.element(mk.BLOCK_GROUP, mk.element(mk.BLOCK, block) + mk.element(mk.REFERENCE, b"\xff"))
    cluster = mk.CLUSTER.to_bytes(4, "big") + unknown + mk.number(mk.TIMESTAMP, 10) + mk.element(mk.SIMPLE_BLOCK, b"\x81\x00\x00\x80xyz") + group
    media = mk._HEAD + mk.SEGMENT.to_bytes(4, "big") + unknown + cluster + cluster
    got = mk.read(media)
    assert got["error"] is None
    assert [(p[1] // 10**6, p[2], p[3], media[p[5] : p[5] + p[6]], p[7]) for p in got["packets"]] == [
        (10, 0, 0, b"xyz", True), (15, 0, 1, b"abc", False), (10, 1, 0, b"xyz", True), (15, 1, 1, b"abc", False)]


def test_damage(spark):
    media = mk.write(bytes(5 * mk.FRAME))
    assert mk.read(b"not media")["error"] and mk.read(None)["packets"] == [] and mk.read(b"")["error"] is None
    for n in range(0, len(media), 97):
        mk.read(media[:n])
    rows = [(1, bytearray(media), "x"), (2, bytearray(media[:2000]), "x"), (3, None, "x"), (4, bytearray(b""), "x")]
    got = mk.packets(spark.createDataFrame(rows, "id long, media binary, track string")).collect()
    assert sum(r.id == 1 for r in got) == 5 and [r.error is not None for r in got if r.id == 2] == [True]
    assert not any(r.id > 2 for r in got)


def test_stored(spark):
    texts = [None, "", "a", "é" * 288, "x" * 577, "y" * 300_000]
    docs = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, feature string")
    for r in mk.stored(docs).collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
        assert r.media_sha256 == hashlib.sha256(mk.write(payload)).hexdigest() and r.media_bytes == len(mk.write(payload))
    assert mk.stored(docs.limit(0)).count() == 0
