"""Operator 7: WARC archives as a chunked record table.

A record is rows (record, chunk_no, data, digest) of at most ``chunk_bytes`` each, so that neither writing nor reading ever
holds more of a payload than a chunk.  The digest is that of the payload up to the chunk's end, carried from chunk to chunk;
the reader carries its own and holds it against each.  Joined in order, a record's chunks are the bytes of a WARC/1.1 record.
The table is Parquet in the shared folder.  Which record is the response is settled on digests alone; payloads then meet
the answer by page and digest, so that the copies of a page spread over tasks.  The reader takes a record where its file is
read; only the chunks of records that a split of the file cuts, or that are longer than ``FLUSH_BYTES``, are shuffled and sorted.

Defined results: a null html is an empty payload; a null url is written as an empty one; of rows that repeat the smallest
page_id of a payload each is a response; a null page_id revisits any other, and is a response where no other has the
payload; no pages give no records; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_batches, stored, text_or_empty

CHUNK_BYTES, FLUSH_BYTES = 16_384, 4_000_000
DATE = "2024-01-01T00:00:00Z"
_CHUNKS = "record long, chunk_no int, data binary, digest binary"
_RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_NO_RESULT, _NO_CHUNK = (None,) * 5, (None,) * 4


def record_head(page_id: int | None, url: str, digest: str, payload_bytes: int, refers_to: int | None) -> bytes:
    """Everything of a record before its payload; a revisit record has no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", "WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url), "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines.append(f"Content-Length: {len(http) + (payload_bytes if refers_to is None else 0)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def plan_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, sha1, payload_bytes, refers_to: of equal payloads the smallest page_id is the response."""
    rows = pages.select(F.col("page_id").cast("long"), text_or_empty("url").alias("url"), F.encode(text_or_empty("html"), "UTF-8").alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    names = ["page_id", "sha1", "payload_bytes"]
    digests = rows.select(*names)
    first = digests.where(F.col("payload_bytes") >= least_bytes).groupBy("sha1", "payload_bytes").agg(F.min("page_id").alias("first_id"), F.count("*").alias("rows")).where("rows > 1 and first_id is not null")
    copies = digests.join(first, ["sha1", "payload_bytes"]).where(F.col("page_id").isNull() | (F.col("first_id") < F.col("page_id")))
    # a missing page_id can't be a key, so it takes the place of a number that its row leaves empty
    keyed = lambda df: df.withColumns({"_id": F.coalesce("page_id", F.lit(0)), "_none": F.col("page_id").isNull()})
    refers = keyed(copies).groupBy("_id", "_none", "sha1", "payload_bytes").agg(F.min("first_id").alias("refers_to"))
    return keyed(rows).join(refers, ["_id", "_none", "sha1", "payload_bytes"], "left").select("page_id", "url", "payload", "sha1", "payload_bytes", "refers_to")


def write_archives(pages: DataFrame, least_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The stored chunk table."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, bytes, bytes]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64(), pa.int32(), pa.binary(), pa.binary()])], ["record", "chunk_no", "data", "digest"])

        for batch in batches:
            for record, page_id, url, payload, sha1, n, refers_to in zip(*(batch[c] for c in ("record", "page_id", "url", "payload", "sha1", "payload_bytes", "refers_to"))):
                digest = base64.b32encode(bytes.fromhex(sha1.as_py())).decode()
                head = record_head(page_id.as_py(), url.as_py(), digest, n.as_py(), refers_to.as_py())
                body = memoryview(payload.as_buffer()) if payload.as_buffer() is not None and not refers_to.is_valid else memoryview(b"")
                running = hashlib.sha1()
                rows.append((record.as_py(), 0, head, running.digest()))
                number = 1
                for at in range(0, len(body), chunk_bytes):
                    part = bytes(body[at : at + chunk_bytes])
                    running.update(part)
                    rows.append((record.as_py(), number, part, running.digest()))
                    held += chunk_bytes
                    number += 1
                    if held >= FLUSH_BYTES:
                        yield flush()
                        rows, held = [], 0
                rows.append((record.as_py(), number, b"\r\n\r\n", running.digest()))
                held += len(head)
        if rows:
            yield flush()

    planned = plan_records(pages, least_bytes).withColumn("record", F.monotonically_increasing_id())
    return stored(map_batches(planned, chunks, _CHUNKS))


@dataclass
class RecordReader:
    """Takes a record's chunks in order; keeps its head and a running digest, never its payload."""

    head: bytearray = field(default_factory=bytearray)
    fields: dict[str, str] | None = None
    left: int = 0
    seen: int = 0
    http: dict[str, str] | None = None
    digest: object = field(default_factory=hashlib.sha1)

    def feed(self, data: bytes, digest: bytes) -> None:
        """Takes the next chunk, whose ``digest`` is that of the payload up to its end."""
        self._take(data)
        if self.digest.digest() != digest:
            raise ValueError("a chunk is missing, damaged or out of order")

    def _take(self, data: bytes) -> None:
        while data:
            if self.http is None:
                self.head += data
                data = b""
                cut = self.head.find(b"\r\n\r\n")
                if cut < 0:
                    return
                lines = self.head[:cut].decode().split("\r\n")
                named = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
                data = bytes(self.head[cut + 4 :])
                self.head.clear()
                if self.fields is None:
                    if lines[0] != "WARC/1.1":
                        raise ValueError("not a WARC/1.1 record")
                    self.fields, self.left = named, int(named["Content-Length"])
                else:
                    self.http = named
                self.left -= (cut + 4) if self.http is not None else 0
            else:
                part = data[: self.left]
                self.digest.update(part)
                self.seen += len(part)
                self.left -= len(part)
                self.head += data[len(part) :]
                data = b""

    def ended(self) -> bool:
        return self.http is not None and not self.left and bytes(self.head) == b"\r\n\r\n"

    def row(self) -> tuple[int | None, int, str, str, int | None]:
        if not self.ended():
            raise ValueError("a record is cut short")
        named, number = self.fields, lambda v: int(v[len("<urn:page:") : -1]) if v != "<urn:page:>" else None
        digest = named["WARC-Payload-Digest"].removeprefix("sha1:")
        if named["WARC-Type"] == "response" and base64.b32encode(self.digest.digest()).decode() != digest:
            raise ValueError("a payload doesn't have its record's digest")
        refers = named.get("WARC-Refers-To")
        return number(named["WARC-Record-ID"]), int(self.http["Content-Length"]), digest, named["WARC-Type"], refers and number(refers)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    names, types = zip(*(f.split() for f in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, k in zip(zip(*rows), types)], list(names))


def _read_in_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of records whose chunks follow one another here, and the chunks, as they are, of all others.

    A record's chunks are held until it ends, or until ``FLUSH_BYTES`` of them show that it is an oversized one.
    """
    out: list[tuple] = []
    size = 0
    current, reader = None, None  # no reader: the current record's chunks are passed on
    held: list[tuple[int, int, bytes, bytes]] = []
    held_bytes = 0
    for batch in batches:
        for record, number, value, digest in zip(batch["record"].to_pylist(), batch["chunk_no"].to_pylist(), batch["data"], batch["digest"].to_pylist()):
            data = value.as_py()
            if record != current or number == 0:
                out += [_NO_RESULT + chunk for chunk in held]
                size += held_bytes
                current, reader, held, held_bytes = record, RecordReader() if number == 0 else None, [], 0
            held.append((record, number, data, digest))
            held_bytes += len(data)
            if reader and number == len(held) - 1:
                reader.feed(data, digest)
                if reader.ended():
                    out.append(reader.row() + _NO_CHUNK)
                    reader, held, held_bytes = None, [], 0
            else:
                reader = None
            if not reader or held_bytes >= FLUSH_BYTES:
                out += [_NO_RESULT + chunk for chunk in held]
                size += held_bytes
                reader, held, held_bytes = None, [], 0
            if len(out) >= 5000 or size >= FLUSH_BYTES:
                yield _batch(out, f"{_RESULT}, {_CHUNKS}")
                out, size = [], 0
    out += [_NO_RESULT + chunk for chunk in held]
    if out:
        yield _batch(out, f"{_RESULT}, {_CHUNKS}")


def _read_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of records whose chunks come in order."""
    current, reader = None, None
    rows: list[tuple] = []
    for batch in batches:
        for record, data, digest in zip(batch["record"].to_pylist(), batch["data"], batch["digest"].to_pylist()):
            if record != current:
                if reader:
                    rows.append(reader.row())
                current, reader = record, RecordReader()
            reader.feed(data.as_py(), digest)
        if len(rows) >= 5000:
            yield _batch(rows, _RESULT)
            rows = []
    if reader:
        rows.append(reader.row())
    if rows:
        yield _batch(rows, _RESULT)


def read_archives(chunks: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    The chunks may stand in any order; those that stand in their record's order are not shuffled.
    """
    mixed = stored(map_batches(chunks.select("record", "chunk_no", "data", "digest"), _read_in_place, f"{_RESULT}, {_CHUNKS}"))
    rest = mixed.where("record is not null").select("record", "chunk_no", "data", "digest")
    apart = map_batches(rest.repartition("record").sortWithinPartitions("record", "chunk_no"), _read_sorted, _RESULT)
    return mixed.where("record is null").select(*[f.split()[0] for f in _RESULT.split(", ")]).unionByName(apart)
