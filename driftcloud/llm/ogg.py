"""Operator 1: media columns as Ogg streams (RFC 3533).

A payload is stored as 8-bit mono samples in packets of one logical stream; a second logical stream of the same file
holds its length and a checksum per packet.  Reading verifies every page's checksum, splits the pages by serial number,
reassembles packets from lacing values (also over page borders) and derives each packet's time from granule positions.

Defined results: a null text is an empty one, whose payload is one unit of zero bytes; equal texts give equal files
(nothing in a file depends on the row); repeated rows and null ids are kept; no rows give no rows; extra columns are
ignored.  A damaged page raises ``OggError``, or is counted and skipped when ``strict`` is false.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_batches, stored, text_or_empty

UNIT, RATE, PACKET_SAMPLES = 64, 8000, 4096
CONTINUED, FIRST, LAST = 1, 2, 4
_HEAD = struct.Struct("<4sBBqIIIB")
_SAMPLES, _INFO = b"\x01pcm8", b"\x01info"
_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class OggError(ValueError):
    pass


def page_checksum(page: bytes) -> int:
    """CRC-32 with polynomial 0x04c11db7, not reflected, from 0: zlib's on mirrored bytes, mirrored."""
    return int(f"{zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF:032b}"[::-1], 2)


@dataclass
class Writer:
    """Pages of one logical stream."""

    serial: int
    sequence: int = 0

    def pages(self, packets: list[bytes], granules: list[int], first: bool = False, last: bool = False) -> Iterator[bytes]:
        """A page has up to 255 segments; a packet may run on into the next page."""
        lacing, body, granule, continued, sent = bytearray(), bytearray(), -1, False, 0

        def page(flags: int) -> bytes:
            head = _HEAD.pack(b"OggS", 0, flags, granule, self.serial, self.sequence, 0, len(lacing)) + bytes(lacing)
            self.sequence += 1
            whole = head + bytes(body)
            return whole[:22] + struct.pack("<I", page_checksum(whole)) + whole[26:]

        for packet, end in zip(packets, granules):
            for at in range(0, len(packet) + 1, 255):
                if len(lacing) == 255:
                    yield page((CONTINUED if continued else 0) | (FIRST if first and not sent else 0))
                    sent += 1
                    continued, granule = at > 0, -1
                    lacing.clear()
                    body.clear()
                part = packet[at : at + 255]
                lacing.append(len(part))
                body += part
            granule = end
        yield page((CONTINUED if continued else 0) | (FIRST if first and not sent else 0) | (LAST if last else 0))


def encode_payload(payload: bytes, n_bytes: int) -> bytes:
    """An Ogg file: the payload's samples and, beside them, its unpadded length and each packet's CRC-32."""
    samples, info = Writer(zlib.crc32(payload)), Writer(zlib.crc32(payload) ^ 0xFFFFFFFF)
    out = [*samples.pages([_SAMPLES + struct.pack("<I", RATE)], [0], first=True), *info.pages([_INFO + struct.pack("<Q", n_bytes)], [0], first=True)]
    packets = [payload[a : a + PACKET_SAMPLES] for a in range(0, len(payload), PACKET_SAMPLES)]
    ends = np.cumsum([len(p) for p in packets]).tolist()
    step = 32
    for k in range(0, len(packets), step):
        last = k + step >= len(packets)
        out += samples.pages(packets[k : k + step], ends[k : k + step], last=last)
        out += info.pages([struct.pack("<I", zlib.crc32(p)) for p in packets[k : k + step]], ends[k : k + step], last=last)
    return b"".join(out)


@dataclass
class Stream:
    packets: list[bytes] = field(default_factory=list)
    granules: list[int | None] = field(default_factory=list)  # of the last packet that ends on a page, else None
    pages: int = 0
    ended: bool = False
    sequence: int = 0
    held: bytearray | None = None  # a packet that runs on


def read_ogg(data: bytes, strict: bool = True) -> tuple[dict[int, Stream], int]:
    """Logical streams by serial number, and how many pages were damaged."""
    streams: dict[int, Stream] = {}
    at = damaged = 0
    view = memoryview(data)
    while at < len(data):
        head_end = at + _HEAD.size
        ok = data[at : at + 4] == b"OggS" and head_end <= len(data)
        if ok:
            _, version, flags, granule, serial, sequence, crc, n = _HEAD.unpack_from(data, at)
            lacing = data[head_end : head_end + n]
            end = head_end + n + sum(lacing)
            ok = version == 0 and len(lacing) == n and end <= len(data)
            ok = ok and page_checksum(bytes(view[at : at + 22]) + bytes(4) + bytes(view[at + 26 : end])) == crc
        if not ok:
            if strict:
                raise OggError(f"damaged page at byte {at}")
            damaged += 1
            at = data.find(b"OggS", at + 1)
            if at < 0:
                break
            continue
        stream = streams.setdefault(serial, Stream())
        if sequence != stream.sequence or bool(flags & CONTINUED) != (stream.held is not None):
            if strict:
                raise OggError(f"page {stream.sequence} of stream {serial} is missing")
            stream.held = None
        skip = bool(flags & CONTINUED) and stream.held is None  # the tail of a packet whose start is lost
        held, body, ended_here = stream.held or bytearray(), head_end + n, 0
        for i, size in enumerate(lacing):
            held += view[body : body + size]
            body += size
            if size < 255:
                if not skip:
                    stream.packets.append(bytes(held))
                    stream.granules.append(None)
                    ended_here += 1
                held, skip = bytearray(), False
        stream.held = held if n and lacing[-1] == 255 else None
        if ended_here and granule >= 0:
            stream.granules[-1] = granule
        stream.pages += 1
        stream.sequence = sequence + 1
        stream.ended |= bool(flags & LAST)
        at = end
    return streams, damaged


def packet_times(stream: Stream, rate: int) -> list[float | None]:
    """Seconds at which each sample packet ends: granules where a page gives one, counted back over packets' samples elsewhere."""
    times: list[float | None] = [None] * len(stream.packets)
    after: int | None = None
    for i in range(len(stream.packets) - 1, -1, -1):
        after = stream.granules[i] if stream.granules[i] is not None else after
        times[i] = None if after is None else after / rate
        after = None if after is None else after - len(stream.packets[i])
    return times


@dataclass
class Media:
    payload: bytes
    n_bytes: int
    feature: str


def decode_media(data: bytes) -> Media:
    """The payload, its unpadded length and features, from the stored bytes alone."""
    streams, damaged = read_ogg(data)
    kinds = {s.packets[0][:5]: s for s in streams.values() if s.packets}
    samples, info = kinds[_SAMPLES], kinds[_INFO]
    rate = struct.unpack_from("<I", samples.packets[0], 5)[0]
    body = Stream(samples.packets[1:], samples.granules[1:])
    if [struct.unpack("<I", p)[0] for p in info.packets[1:]] != [zlib.crc32(p) for p in body.packets] or not samples.ended:
        raise OggError("the streams of one file disagree")
    payload = b"".join(body.packets)
    wave = np.frombuffer(payload, np.uint8).astype(np.int64)
    seconds = packet_times(body, rate)[-1]
    feature = f"rate={rate};streams={len(streams)};pages={sum(s.pages for s in streams.values())};packets={len(body.packets)};ms={round(seconds * 1000)};sum={wave.sum()};energy={(wave * wave).sum()};steps={np.abs(np.diff(wave)).sum()};damaged={damaged}"
    return Media(payload, struct.unpack_from("<Q", info.packets[0], 5)[0], feature)


def write_media(docs: DataFrame, unit: int = UNIT) -> DataFrame:
    """The stored media table: doc_id, media (an Ogg file per document)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = []
            for text in batch["text"]:
                raw = text.as_py().encode()
                files.append(encode_payload(raw + bytes(-len(raw) % unit if raw else unit), len(raw)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(files, pa.binary())], ["doc_id", "media"])

    return stored(map_batches(docs.select(F.col("doc_id").cast("long"), text_or_empty("text").alias("text")), encode, "doc_id long, media binary"))


def read_media(media: DataFrame, unit: int = UNIT) -> DataFrame:
    """Per stored file: lengths, digests and features of what is read back."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, file in zip(batch["doc_id"].to_pylist(), batch["media"]):
                data = file.as_py()
                m = decode_media(data)
                rows.append((doc_id, m.n_bytes, len(m.payload), hashlib.sha256(m.payload).hexdigest(), zlib.crc32(m.payload[-unit:]), len(data), hashlib.sha256(data).hexdigest(), m.feature))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [f.split()[0] for f in schema.split(", ")])

    return map_batches(media.select("doc_id", "media"), decode, schema)
