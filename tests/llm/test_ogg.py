import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import ogg


def slow_checksum(data):
    crc = 0
    for x in data:
        crc ^= x << 24
        for _ in range(8):
            crc = ((crc << 1) ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=600))
def test_checksum(data):
    assert ogg.checksum(data) == slow_checksum(data)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 255, 4095, 4096, 4097, 65024, 65025, 65026, 400_000])
def test_round_trip_and_damage(n):
    data = random.Random(n).randbytes(n)
    stored = ogg.encode(data)
    media = ogg.read(stored)
    assert media.payload == ogg.pad(data) and media.n_bytes == n and stored == ogg.encode(data)
    assert media.sound.granules[-1] == len(media.payload) and media.sound.granules == sorted(media.sound.granules)
    # A page that ends a packet has the time at which its last packet ends: packets end every 4096 samples, at 8000 a second.
    ends = [min(k, len(media.payload)) / 8000 for k in range(0, len(media.payload) + 4096, 4096)]
    assert set(media.times) <= set(ends) and media.times[0] == 0 and media.times[-1] == len(media.payload) / 8000
    assert len(media.times) >= len(media.payload) // (255 * 255)
    for at in random.Random(n + 1).sample(range(len(stored)), 12):
        with pytest.raises(ogg.OggError):
            ogg.read(stored[:at] + bytes([stored[at] ^ 4]) + stored[at + 1 :])
    with pytest.raises(ogg.OggError):
        ogg.read(stored[:-1])


def test_packets_across_pages_and_several_streams():
    packets = [(b"head", 0)] + [(random.Random(k).randbytes(k), k) for k in (0, 254, 255, 256, 510, 100_000, 3)]
    a, b = list(ogg._pages(1, packets)), list(ogg._pages(2, packets[:3]))
    mixed = b"".join(x for pair in zip(a, b) for x in pair) + b"".join(a[len(b) :] + b[len(a) :])
    got = {s.serial: s.packets for s in ogg.decode(mixed)}
    assert got == {1: [p for p, _ in packets], 2: [p for p, _ in packets[:3]]}
    with pytest.raises(ogg.OggError):
        ogg.decode(b"".join(a[:1] + a[2:]))


def test_documents(docs, odd):
    df = docs(odd, extra=True)
    got = {r.doc_id: r for r in ogg.describe(ogg.store(df, ["doc_id"]), ["doc_id"]).collect()}
    for i, t in enumerate(odd):
        data = (t or "").encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes == len(ogg.encode(data)) and r.media_sha256 == hashlib.sha256(ogg.encode(data)).hexdigest()
    assert got[6][1:] == got[7][1:] and got[0][1:] == got[1][1:]
    assert ogg.describe(ogg.store(docs([]), ["doc_id"]), ["doc_id"]).collect() == []
