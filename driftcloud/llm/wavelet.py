"""Operator 9: token ids as one compressed wavelet matrix per shard.

A shard holds whole documents in ascending doc_id order, up to about ``SHARD_TOKENS`` tokens (a longer document has a
shard of its own).  Its file is self-contained: a directory; the documents' ids and the number of end ids up to each one's
last; then for each bit of the id, most significant first, a bit-plane, stably partitioned by the planes above it, with the
ones in each block of ``BLOCK_BITS``.  Planes are compressed in frames of ``FRAME_BYTES`` that the directory points to, so that
access, rank and select inflate only the frames that they touch.  Documents' bounds are not stored: a document ends at the
end id that ``select`` finds.  The files are the rows of a Parquet table in the shared folder, so that Spark commits, retries and
finds them on any store.

Defined results: a null text is an empty one (its end id remains); a null doc_id sorts first; equal doc_ids stand in
text order; no documents give no files and no rows; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from .common import map_batches, stored, text_or_empty
from .token_cache import TOKEN_BATCH, encoder

MAGIC = b"WVM2"
SHARD_TOKENS = 2_000_000
BLOCK_BITS, FRAME_BYTES = 512, 1 << 16


class Plane:
    """A bit-plane in memory: its bytes, padded to whole blocks, and the ones in each block."""

    def __init__(self, n: int, packed: np.ndarray):
        self.n, self.packed = n, np.pad(packed, (0, -len(packed) % (BLOCK_BITS // 8)))
        self._before: np.ndarray | None = None

    def whole(self) -> np.ndarray:
        return self.packed

    def blocks(self, which: np.ndarray) -> np.ndarray:
        """Bytes of the blocks, one row each."""
        return self.packed.reshape(-1, BLOCK_BITS // 8)[which]

    def ones(self) -> np.ndarray:
        return np.bitwise_count(self.packed.reshape(-1, BLOCK_BITS // 8)).sum(axis=1, dtype=np.uint16)

    def before(self) -> np.ndarray:
        """Ones before each block, and in all."""
        if self._before is None:
            self._before = np.concatenate([[0], np.cumsum(self.ones(), dtype=np.int64)])
        return self._before

    def _bits(self, which: np.ndarray) -> np.ndarray:
        return np.unpackbits(self.blocks(which), axis=1, bitorder="little")

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        block = np.minimum(at // BLOCK_BITS, max(0, len(self.before()) - 2))
        inside = np.arange(BLOCK_BITS) < (at - block * BLOCK_BITS)[:, None]
        return self.before()[block] + (self._bits(block) & inside).sum(axis=1, dtype=np.int64)

    def bit(self, at: np.ndarray) -> np.ndarray:
        return self._bits(at // BLOCK_BITS)[np.arange(len(at)), at % BLOCK_BITS]

    def select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Places of the k-th (from 0) ones or zeros."""
        before = self.before() if one else np.arange(len(self.before())) * BLOCK_BITS - self.before()
        block = np.searchsorted(before, k, side="right") - 1
        bits = self._bits(block) if one else 1 - self._bits(block)
        return block * BLOCK_BITS + np.argmax(np.cumsum(bits, axis=1) > (k - before[block])[:, None], axis=1)


class StoredPlane(Plane):
    """A bit-plane in a file, of which a frame is inflated when it is first touched."""

    def __init__(self, n: int, counts: bytes, frames: list[bytes]):
        self.n, self.counts, self.frames, self._before = n, counts, frames, None
        self.open: dict[int, np.ndarray] = {}

    def _frame(self, i: int) -> np.ndarray:
        if i not in self.open:
            self.open[i] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.frames[i]), np.uint8)
        return self.open[i]

    def whole(self) -> np.ndarray:
        return np.concatenate([self._frame(i) for i in range(len(self.frames))])

    def blocks(self, which: np.ndarray) -> np.ndarray:
        each = FRAME_BYTES * 8 // BLOCK_BITS
        out = np.empty((len(which), BLOCK_BITS // 8), np.uint8)
        for i in np.unique(which // each).tolist():
            mine = which // each == i
            out[mine] = self._frame(i).reshape(-1, BLOCK_BITS // 8)[which[mine] % each]
        return out

    def ones(self) -> np.ndarray:
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(self.counts), "<u2")


class WaveletMatrix:
    """Access, rank and select over a sequence of ids; each takes one number or an array of them."""

    def __init__(self, n: int, planes: list[Plane], zeros: list[int]):
        self.n, self.planes, self.zeros = n, planes, zeros

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        n_bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        v = ids.astype(np.uint16 if n_bits <= 16 else np.uint32)
        planes, zeros = [], []
        for shift in range(n_bits - 1, -1, -1):
            ones = (v & v.dtype.type(1 << shift)) != 0
            low = np.compress(~ones, v)
            planes.append(Plane(len(v), np.packbits(ones, bitorder="little")))
            zeros.append(len(low))
            v = np.concatenate([low, np.compress(ones, v)])
        return cls(len(ids), planes, zeros)

    def decode(self) -> np.ndarray:
        """All ids, from the lowest plane up."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        v = np.zeros(self.n, kind)
        for bit, (plane, zeros) in enumerate(zip(reversed(self.planes), reversed(self.zeros))):
            ones = np.unpackbits(plane.whole(), count=self.n, bitorder="little").view(bool)
            up = np.empty_like(v)
            up[np.flatnonzero(~ones)] = v[:zeros]
            up[np.flatnonzero(ones)] = v[zeros:] | kind(1 << bit)
            v = up
        return v

    def access(self, at: int | np.ndarray) -> int | np.ndarray:
        i = np.atleast_1d(at).astype(np.int64)
        value = np.zeros(len(i), np.int64)
        for plane, zeros in zip(self.planes, self.zeros):
            ones, one = plane.rank(i), plane.bit(i).astype(bool)
            value, i = value << 1 | one, np.where(one, zeros + ones, i - ones)
        return value if isinstance(at, np.ndarray) else int(value[0])

    def _range(self, token: int, at: np.ndarray) -> tuple[int, np.ndarray]:
        """Where the lowest plane's successor has the occurrences of ``token``, and where those before each place end."""
        ends = np.append(at, 0).astype(np.int64)  # the last is the range's start
        for level, (plane, zeros) in enumerate(zip(self.planes, self.zeros)):
            ones = plane.rank(ends)
            ends = zeros + ones if token >> (len(self.planes) - 1 - level) & 1 else ends - ones
        return int(ends[-1]), ends[:-1]

    def rank(self, token: int, at: int | np.ndarray) -> int | np.ndarray:
        """Occurrences of ``token`` before a place."""
        if token >> len(self.planes) or not self.n:
            return np.zeros(len(at), np.int64) if isinstance(at, np.ndarray) else 0
        first, ends = self._range(token, np.atleast_1d(at))
        return ends - first if isinstance(at, np.ndarray) else int(ends[0]) - first

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int | np.ndarray) -> int | np.ndarray:
        """Place of the k-th (from 0) occurrence of ``token``; -1 where there are fewer."""
        wanted = np.atleast_1d(k).astype(np.int64)
        out = np.full(len(wanted), -1, np.int64)
        known = (wanted >= 0) & (wanted < self.count(token))
        if known.any():
            i = self._range(token, np.zeros(0, np.int64))[0] + wanted[known]
            for level in range(len(self.planes) - 1, -1, -1):
                one = bool(token >> (len(self.planes) - 1 - level) & 1)
                i = self.planes[level].select(i - self.zeros[level] if one else i, one)
            out[known] = i
        return out if isinstance(k, np.ndarray) else int(out[0])


def shard_bytes(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, end_id: int = 0) -> bytes:
    """A shard's file; each document's last id is ``end_id`` (others of its ids may be, too)."""
    wm, compress = WaveletMatrix.build(ids), zstandard.ZstdCompressor(level=1).compress
    known = np.array([d is not None for d in doc_ids], np.uint8)
    ends = np.cumsum(ids == end_id, dtype=np.int64)[np.cumsum(lengths) - 1]
    frames = [compress(np.array([d or 0 for d in doc_ids], "<i8").tobytes() + known.tobytes() + ends.astype("<u8").tobytes())]
    for plane in wm.planes:
        raw = plane.whole().tobytes()
        frames += [compress(plane.ones().astype("<u2").tobytes()), *(compress(raw[at : at + FRAME_BYTES]) for at in range(0, len(raw), FRAME_BYTES))]
    head = struct.pack("<QIII", wm.n, len(doc_ids), len(wm.planes), end_id) + np.array(wm.zeros, "<u8").tobytes()
    return MAGIC + head + np.array([len(f) for f in frames], "<u4").tobytes() + b"".join(frames)


def open_shard(data: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """Documents' ids, the places of their last ids, and the matrix; planes stay compressed until they are asked for."""
    if data[:4] != MAGIC:
        raise ValueError("not a wavelet-matrix shard")
    n, n_docs, n_planes, end_id = struct.unpack_from("<QIII", data, 4)
    zeros = np.frombuffer(data, "<u8", n_planes, 24).tolist()
    each = 1 + -(-(-(-n // BLOCK_BITS) * (BLOCK_BITS // 8)) // FRAME_BYTES)  # a plane's counts and frames
    sizes = np.frombuffer(data, "<u4", 1 + n_planes * each, 24 + 8 * n_planes).astype(np.int64)
    at = np.cumsum(np.concatenate([[24 + 8 * n_planes + 4 * len(sizes)], sizes])).tolist()
    frames = [memoryview(data)[a:b] for a, b in zip(at[:-1], at[1:])]
    docs = zstandard.ZstdDecompressor().decompress(frames[0])
    doc_ids, known, ends = np.frombuffer(docs, "<i8", n_docs).tolist(), np.frombuffer(docs, "u1", n_docs, 8 * n_docs), np.frombuffer(docs, "<u8", n_docs, 9 * n_docs).astype(np.int64)
    planes = [StoredPlane(n, frames[1 + k * each], frames[2 + k * each : 1 + (k + 1) * each]) for k in range(n_planes)]
    wm = WaveletMatrix(n, planes, zeros)
    return [d if k else None for d, k in zip(doc_ids, known)], wm.select(end_id, ends - 1), wm


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int = 0, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The stored table of shard files: part, shard, n_tokens, file (ascending part and shard is ascending doc_id)."""
    end = np.array([end_id], np.uint32)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard = TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        found: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate([x for doc in found for x in (doc, end)])
            file = shard_bytes(doc_ids, np.array([len(x) + 1 for x in found]), ids, end_id)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([file], pa.binary())], ["part", "shard", "n_tokens", "file"])

        for batch in batches:
            ids, bounds = encoder(tokenizer_path).encode(batch["text"])
            for doc_id, a, b in zip(batch["doc_id"].to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                if found and held + b - a + 1 > shard_tokens:
                    yield flush()
                    shard, doc_ids, found, held = shard + 1, [], [], 0
                doc_ids.append(doc_id)
                found.append(ids[a:b])
                held += b - a + 1
        if found:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("long"), text_or_empty("text").alias("text"))
    ordered = ordered.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return stored(map_batches(ordered, shards, "part int, shard int, n_tokens long, file binary", rows=TOKEN_BATCH), "none")


def read_shards(shards: DataFrame) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, file in zip(batch["part"].to_pylist(), batch["shard"].to_pylist(), batch["file"]):
                doc_ids, last, wm = open_shard(file.as_py())
                ids = memoryview(wm.decode().astype("<u4").tobytes())
                ends = last + 1
                starts = np.concatenate([[0], ends[:-1]])
                crcs = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array([shard] * n, pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crcs, pa.int64())],
                    ["part", "shard", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    # One row for each part (a part is a Spark partition of the writer) is summed up in order; shards inside a part need no wider order.
    sizes = shards.select("part", "shard", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = parts.select("part", (F.sum("part_tokens").over(Window.orderBy("part")) - F.col("part_tokens")).alias("part_start"))
    in_part = sizes.select("part", "shard", (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens")).alias("shard_start"))
    starts = in_part.join(before, "part").select("part", "shard", (F.col("part_start") + F.col("shard_start")).alias("shard_start"))
    docs = map_batches(shards.select("part", "shard", "file"), read, "part int, shard int, doc_id long, inside long, n_tokens long, ids_crc32 long", rows=1)
    return docs.join(starts, ["part", "shard"]).select("doc_id", (F.col("shard_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
