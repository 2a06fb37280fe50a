"""Ogg media columns: texts stored losslessly as packets of 8-bit samples in a physical Ogg stream, read back and described.

The stored form has two logical streams, grouped: "LMPCM8" with the payload as packets of PACKET samples, whose granule positions
count samples, and "LMINFO" with one packet that tells the length before padding. Their pages alternate, so that reading back has
to demultiplex them. Reading verifies each page's checksum and sequence number, reassembles packets from the lacing values across
page borders, and derives each page's time from its granule position.

Ogg's checksum is a CRC-32 over unreflected bits from zero; zlib's CRC over the bytes with their bits turned is the same but for
turned bits and inverted ends, so both writing and reading run at zlib's speed.

Defined results: a null text counts as empty; the payload has zero bytes up to a positive multiple of 64; equal texts give equal
bytes (serial numbers come from the payload), and so do ties and repeated rows, which each get their row; very long texts are
stored whole; broken pages raise OggError; an empty table gives an empty result; extra columns are ignored by store() and
describe() but for those kept, and what is made takes the place of any so named.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from leafmill.llm.common import per_slice, settle

BLOCK = 64
PACKET = 4096
RATE = 8000
#: Lacing values of one page at most, as the format has it (fixed value).
SEGMENTS = 255
_TURN8 = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_HEADER = struct.Struct("<4sBBqIIIB")


class OggError(ValueError):
    """The bytes are no whole and sound Ogg stream."""


def checksum(page: bytes) -> int:
    """Ogg's CRC of a page whose checksum field is zero."""
    return int(f"{zlib.crc32(page.translate(_TURN8), 0xFFFFFFFF) ^ 0xFFFFFFFF:032b}"[::-1], 2)


def pad(data: bytes) -> bytes:
    return data + bytes(-len(data) % BLOCK if data else BLOCK)


def _page(serial: int, number: int, granule: int, flags: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEADER.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = checksum(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def _pages(serial: int, packets: list[tuple[bytes, int]]) -> Iterator[bytes]:
    """Pages of a logical stream; packets are bytes and the granule position at their end. The first packet has a page of its own."""
    number = 0

    def emit(lacing: list[int], body: list[bytes], granule: int, continued: bool, last: bool) -> bytes:
        nonlocal number
        flags = continued | (number == 0) << 1 | last << 2
        page = _page(serial, number, granule, flags, bytes(lacing), b"".join(body))
        number += 1
        return page

    lacing: list[int] = []
    body: list[bytes] = []
    granule, continued = -1, False
    for k, (packet, end) in enumerate(packets):
        sizes = [255] * (len(packet) // 255) + [len(packet) % 255]
        at = 0
        while sizes:
            room = SEGMENTS - len(lacing)
            part, sizes = sizes[:room], sizes[room:]
            lacing += part
            body.append(packet[at : at + sum(part)])
            at += sum(part)
            if not sizes:
                granule = end
            if sizes or len(lacing) == SEGMENTS or k == 0:
                yield emit(lacing, body, granule, continued, not sizes and k == len(packets) - 1)
                lacing, body, granule, continued = [], [], -1, bool(sizes)
    if lacing:
        yield emit(lacing, body, granule, continued, True)


def encode(text: bytes) -> bytes:
    payload = pad(text)
    digest = hashlib.sha256(payload).digest()
    serials = (int.from_bytes(digest[:4], "little"), int.from_bytes(digest[:4], "little") ^ 0x5A5A5A5A)
    sound = [(b"LMPCM8" + struct.pack("<II", RATE, PACKET), 0)]
    sound += [(payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in range(0, len(payload), PACKET)]
    info = [(b"LMINFO", 0), (struct.pack("<Q", len(text)), 0)]
    a, b = list(_pages(serials[0], sound)), list(_pages(serials[1], info))
    return b"".join([a[0], b[0], *(page for pair in zip(a[1:], b[1:]) for page in pair), *a[len(b) :], *b[len(a) :]])


@dataclass
class Stream:
    """A logical stream as it was read."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    #: Granule position of each page that ends a packet.
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    open: list[bytes] = field(default_factory=list)

    def times(self, rate: int) -> list[float]:
        """Time in seconds at the end of each page that ends a packet."""
        return [g / rate for g in self.granules]


def decode(data: bytes) -> list[Stream]:
    """The logical streams of a physical stream, in order of their first page."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(data):
        if len(data) < at + _HEADER.size:
            raise OggError(f"a page is cut off at {at}")
        mark, version, flags, granule, serial, number, crc, count = _HEADER.unpack_from(data, at)
        if mark != b"OggS" or version:
            raise OggError(f"no page at {at}")
        lacing = data[at + _HEADER.size : at + _HEADER.size + count]
        body_at = at + _HEADER.size + count
        end = body_at + sum(lacing)
        if len(lacing) < count or end > len(data):
            raise OggError(f"a page is cut off at {at}")
        if checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise OggError(f"wrong checksum at {at}")
        if bool(flags & 2) != (serial not in streams):
            raise OggError(f"a stream begins twice or not at all at {at}")
        stream = streams.setdefault(serial, Stream(serial))
        if stream.ended or number != stream.pages or bool(flags & 1) != bool(stream.open):
            raise OggError(f"pages are missing at {at}")
        stream.pages += 1
        for size in lacing:
            stream.open.append(data[body_at : body_at + size])
            body_at += size
            if size < 255:
                stream.packets.append(b"".join(stream.open))
                stream.open = []
        if granule >= 0:
            stream.granules.append(granule)
        stream.ended = bool(flags & 4)
        at = end
    if any(s.open or not s.ended for s in streams.values()):
        raise OggError("a stream does not end")
    return list(streams.values())


@dataclass
class Media:
    """The payload of stored bytes, the length before padding, and the streams that held it."""

    payload: bytes
    n_bytes: int
    sound: Stream
    rate: int
    pages: int

    @property
    def times(self) -> list[float]:
        return self.sound.times(self.rate)


def read(data: bytes) -> Media:
    streams = decode(data)
    kinds = {s.packets[0][:6]: s for s in streams}
    sound, info = kinds[b"LMPCM8"], kinds[b"LMINFO"]
    payload = b"".join(sound.packets[1:])
    if sound.granules[-1] != len(payload):
        raise OggError("the last granule position is not the number of samples")
    return Media(payload, struct.unpack("<Q", info.packets[1])[0], sound, struct.unpack_from("<I", sound.packets[0], 6)[0], sum(s.pages for s in streams))


def feature(media: Media) -> str:
    """Pages, packets, duration, digest of the pages' times, and mean, spread, zero crossings around the middle and peak of the samples."""
    x = np.frombuffer(media.payload, dtype=np.uint8)
    mean = x.mean(dtype=np.float64)
    crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    spread = float(np.sqrt(max(0.0, np.square(x, dtype=np.float64).mean() - mean * mean)))
    times = hashlib.sha256(",".join(f"{t:.6f}" for t in media.times).encode()).hexdigest()[:16]
    return f"pages={media.pages};packets={len(media.sound.packets) - 1};seconds={media.times[-1]:.6f};times={times};mean={mean:.6f};std={spread:.6f};crossings={crossings};peak={int(x.max())}"


def store(documents: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep and media, the stored bytes of the text."""
    return per_slice(documents, "text", [c for c in keep if c.lower() != "media"], "media binary", lambda s: [pa.array([encode(t.encode()) for t in s.to_pylist()], pa.binary())])


def describe(stored: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep and what is read back from media: lengths, digests and features."""
    added = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    made = StructType.fromDDL(added)
    keep = [c for c in keep if c.lower() not in {*made.names, "media"}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(len(keep)):
                data = value.as_py()
                m = read(data)
                rows.append((m.n_bytes, len(m.payload), hashlib.sha256(m.payload).hexdigest(), zlib.crc32(m.payload[-BLOCK:]), len(data), hashlib.sha256(data).hexdigest(), feature(m)))
            settle()
            columns = list(zip(*rows)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *[pa.array(list(c), k) for c, k in zip(columns, kinds)]], names=names)

    schema = StructType([stored.schema[c] for c in keep] + made.fields)
    names = schema.names
    return stored.select(*[f"`{c}`" for c in keep], "media").mapInArrow(run, schema)
