"""Operator 13: words of passages that repeat, by a count-min prefilter and an exact second pass.

A window is ``window`` consecutive words of one text; each word of a window that also starts anywhere else goes.

1. Sketch.  A window is counted under its anchor, the part of ``GRAM`` words with the least hash in it.  Equal windows have
   equal anchors at equal places, so an anchor's count is never below its window's, and a text has far fewer anchors than
   windows.  Each partition sketches its anchors in two rows of saturating cells; the sketches are merged by chunk.
2. Candidates.  A window is a candidate if its anchor's estimate (the least of its cells) is 2 or more.  A text's
   consecutive candidates are cut into pieces where a window's hash says so.  Texts without candidates are done.
3. Exact pass.  Pieces are grouped by all their words: the windows of a piece that occurs twice do repeat.  Windows of
   pieces that occur once, with those of one specimen of each other piece, are grouped by all their words (both by 128
   bits of hash).  What is there once was overestimated and stays in its text.

Size of the sketch: ``width`` cells a row follow the bytes of the texts up to ``MAX_WIDTH``; only one bit of a cell (counted
twice or more) is sent to the driver and broadcast, 2 * MAX_WIDTH / 8 bytes (128 MB) at most.  Where there are more anchors than
cells the estimates get looser and the exact pass gets more windows, in the limit all; none is lost at any size.

Defined results: a null text has no words; rows are texts of their own, so of repeated rows all windows repeat; null doc_ids pass;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from .common import map_batches, stored, text_or_empty
from .words import BatchWords, RangeHashes, mixed, sliding, texts_of

WINDOW, GRAM = 35, 8
#: Cells of a row, at least and at most, and bytes of text for each.
MIN_WIDTH, MAX_WIDTH, BYTES_PER_CELL = 1 << 16, 1 << 29, 10
#: Cells of a chunk: sketches are merged chunk by chunk.
CHUNK = 1 << 16
#: Anchors that a task holds before it emits their sketch.
HELD_ANCHORS = 1 << 21
#: A new piece begins at a window in so many.
PIECE_WINDOWS = 64
_BASES, _ROW_FACTOR = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)
_MARKED = "rid long, doc_id long, n_words long, kept_sha256 string, packed binary, starts array<int>, sizes array<int>, s1 array<long>, s2 array<long>"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class _Windows:
    """Windows and anchors of a batch of texts; position i of an array stands for the stretch that starts at word i of the batch."""

    def __init__(self, words: BatchWords, window: int):
        self.window, self.gram = window, min(GRAM, window)
        hashes = words.hashes()
        self.ranges = [RangeHashes(hashes, base) for base in _BASES]
        n = max(0, len(hashes) - window + 1)
        left = np.repeat(words.bounds[1:], words.sizes) - np.arange(len(hashes))
        self.valid = left[:n] >= window

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all parts, and the least of each window."""
        parts = mixed(self.ranges[0].of_length(self.gram))
        return parts, sliding(np.minimum, parts, self.window - self.gram + 1)

    def anchor_hashes(self) -> np.ndarray:
        """The hash of each place that is the anchor of a window (of equally small ones all: an overestimate)."""
        parts, least = self.anchors()
        span = self.window - self.gram + 1
        padded = np.zeros(len(least) + 2 * (span - 1), np.uint64)
        padded[span - 1 : span - 1 + len(least)] = np.where(self.valid, least, np.uint64(0))
        return parts[parts == sliding(np.maximum, padded, span)] if len(least) else parts[:0]

    def hashes(self, of: int) -> np.ndarray:
        return mixed(self.ranges[of].of_length(self.window))


def _cells(anchors: np.ndarray, width: int) -> list[np.ndarray]:
    """The cell of each anchor in both rows; cells of the second row follow those of the first."""
    shift = np.uint64(64 - (width.bit_length() - 1))
    return [anchors >> shift, ((anchors * _ROW_FACTOR) >> shift) + np.uint64(width)]


def partition_sketches(texts: DataFrame, window: int, width: int) -> DataFrame:
    """Each partition's sketch: chunk, and the touched cells (two bytes each) with their counts up to 255 (one byte each)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def emitted() -> pa.RecordBatch:
            cells, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            chunks, at = np.unique(cells // np.uint64(CHUNK), return_index=True)
            low, few = (cells % np.uint64(CHUNK)).astype("<u2"), np.minimum(counts, 255).astype(np.uint8)
            return pa.RecordBatch.from_arrays([pa.array(chunks.astype(np.int32)), pa.array([x.tobytes() for x in np.split(low, at[1:])], pa.binary()), pa.array([x.tobytes() for x in np.split(few, at[1:])], pa.binary())], ["chunk", "cells", "counts"])

        n = 0
        for batch in batches:
            anchors = _Windows(BatchWords(texts_of(batch["text"])), window).anchor_hashes()
            held.extend(_cells(anchors, width))
            n += len(anchors)
            if n >= HELD_ANCHORS:
                n = 0
                yield emitted()
        if n:
            yield emitted()

    return map_batches(texts, sketch, "chunk int, cells binary, counts binary")


def merged_sketch(partitions: DataFrame) -> DataFrame:
    """The sum of all partitions' sketches, as bits: chunk, hot (cells counted twice or more)."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, total = None, np.zeros(CHUNK, np.uint16)

        def emitted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([np.packbits(total >= 2, bitorder="little").tobytes()], pa.binary())], ["chunk", "hot"])

        for batch in batches:
            for c, cells, counts in zip(batch["chunk"].to_pylist(), batch["cells"].to_pylist(), batch["counts"].to_pylist()):
                if c != chunk:
                    if chunk is not None:
                        yield emitted()
                    chunk = c
                    total[:] = 0
                at = np.frombuffer(cells, "<u2")  # distinct within a row
                total[at] = np.minimum(total[at] + np.frombuffer(counts, np.uint8), 255)
        if chunk is not None:
            yield emitted()

    return partitions.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(merge, "chunk int, hot binary")


def hot_cells(texts: DataFrame, window: int, width: int) -> np.ndarray:
    """One bit for each cell of both rows: counted twice or more.  2 * width / 8 bytes."""
    bits = np.zeros(2 * width // 8, np.uint8)
    for row in merged_sketch(partition_sketches(texts, window, width)).toLocalIterator():
        bits[row.chunk * CHUNK // 8 : (row.chunk + 1) * CHUNK // 8] = np.frombuffer(row.hot, np.uint8)
    return bits


def _estimated_twice(anchors: np.ndarray, hot: np.ndarray, width: int) -> np.ndarray:
    out = np.ones(len(anchors), bool)
    for cells in _cells(anchors, width):
        out &= (hot[cells >> np.uint64(3)] >> (cells & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return out


def mark_candidates(texts: DataFrame, hot: Broadcast, window: int, width: int) -> DataFrame:
    """Texts (rid, doc_id, text) with their candidates as pieces; a text without any gets its hash and is dropped."""

    def pieces(w: _Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First and last window of each piece, and two hashes of its words."""
        _, least = w.anchors()
        fresh = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]])) if len(least) else np.zeros(0, np.int64)
        twice = np.repeat(_estimated_twice(least[fresh], hot.value, width), np.diff(np.append(fresh, len(least))))
        at = np.flatnonzero(twice & w.valid)
        if not len(at):
            return at, at, at, at
        cut = np.concatenate([[True], (np.diff(at) > 1) | (w.hashes(1)[at[1:]] % np.uint64(PIECE_WINDOWS) == 0)])
        first = at[cut]
        last = at[np.append(np.flatnonzero(cut)[1:], len(at)) - 1]
        length = (last + w.window - first).astype(np.uint64)
        return first, last, *(mixed(r.of(first, last + w.window) + length).view(np.int64) for r in w.ranges)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = BatchWords(texts_of(batch["text"]))
            first, last, s1, s2 = pieces(_Windows(words, window))
            doc = np.searchsorted(words.bounds, first, side="right") - 1
            n = np.bincount(doc, minlength=len(words.joined)) if len(doc) else np.zeros(len(words.joined), np.int64)
            offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            digests = [None if k else hashlib.sha256(t).hexdigest() for t, k in zip(words.joined, n)]
            left = [zstandard.compress(t, 1) if k else None for t, k in zip(words.joined, n)]
            lists = [(first - words.bounds[doc]).astype(np.int32), (last - first + 1).astype(np.int32), s1, s2]
            columns = [batch["rid"], batch["doc_id"], pa.array(words.sizes), pa.array(digests, pa.string()), pa.array(left, pa.binary())]
            columns += [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in lists]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _MARKED.split(", ")])

    return map_batches(texts, mark, _MARKED)


def overestimated(marked: DataFrame, window: int) -> DataFrame:
    """Candidates that occur once: rid and the positions (window starts) in its text."""
    piece = marked.select("rid", F.explode(F.arrays_zip("s1", "s2")).alias("p")).select("rid", "p.*")
    # one text answers for each piece; if it has the piece several times, so much the better for the count
    kinds = piece.groupBy("s1", "s2").agg(F.min("rid").alias("rid"), F.count("*").alias("n"))
    asked = kinds.groupBy("rid").agg(F.collect_list(F.struct("s1", "s2", (F.col("n") > 1).alias("settled"))).alias("asked"))
    fields = ["rid", "packed", "starts", "sizes", "s1", "s2", "a1", "a2", "settled"]
    joined = marked.join(asked.select("rid", F.col("asked.s1").alias("a1"), F.col("asked.s2").alias("a2"), F.col("asked.settled").alias("settled")), "rid").select(*fields)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = BatchWords([zstandard.decompress(t) for t in batch["packed"].to_pylist()])
            w = _Windows(words, window)
            h1, h2 = w.hashes(0).view(np.int64), w.hashes(1).view(np.int64)
            rids, at, offset, weight = [], [], [], []
            for k, (rid, starts, sizes, s1, s2, a1, a2, settled) in enumerate(zip(*(batch[c].to_pylist() for c in fields if c != "packed"))):
                wanted = dict(zip(zip(a1, a2), settled))
                base = int(words.bounds[k])
                for start, size, x, y in zip(starts, sizes, s1, s2):
                    if (x, y) in wanted:
                        rids.append(np.full(size, rid))
                        offset.append(np.arange(start, start + size, dtype=np.int32))
                        at.append(offset[-1] + base)
                        weight.append(np.full(size, 2 if wanted[x, y] else 1))
            if rids:
                i = np.concatenate(at)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h1[i], h2[i], np.concatenate(weight), np.concatenate(rids), np.concatenate(offset))], ["h1", "h2", "weight", "rid", "pos"])

    counted = map_batches(joined, windows, "h1 long, h2 long, weight long, rid long, pos int").groupBy("h1", "h2")
    once = counted.agg(F.sum("weight").alias("n"), F.max("rid").alias("rid"), F.max("pos").alias("pos")).where("n = 1")
    return once.groupBy("rid").agg(F.collect_list("pos").alias("once"))


def without_covered(marked: DataFrame, once: DataFrame, window: int) -> DataFrame:
    """Texts without the words of their candidates but for the positions ``once``."""
    joined = marked.join(once, "rid", "left").select("doc_id", "n_words", "packed", "starts", "sizes", "once")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, n, packed, starts, sizes, single in zip(*(batch[c].to_pylist() for c in ("doc_id", "n_words", "packed", "starts", "sizes", "once"))):
                steps = np.zeros(n + 1, np.int32)  # +1 where a repeated window begins, -1 behind its end
                for a, k in zip(starts, sizes):
                    steps[a : a + k] += 1
                steps[single or []] = 0
                steps[window:] -= steps[: n + 1 - window].copy()
                covered = np.cumsum(steps[:n]) > 0
                kept = b" ".join(w for w, gone in zip(zstandard.decompress(packed).split(b" "), covered.tolist()) if not gone)
                rows.append((doc_id, n, int(covered.sum()), hashlib.sha256(kept).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return map_batches(joined, remove, RESULT)


def remove_repeated_passages(docs: DataFrame, window: int = WINDOW, width: int | None = None) -> DataFrame:
    """Per document: doc_id, n_words, n_removed and the hash of the kept words joined by one space."""
    if window < 2:
        raise ValueError("a window has two words at least")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    if width is None:
        (n_bytes,) = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
        width = max(MIN_WIDTH, min(MAX_WIDTH, 1 << (n_bytes // BYTES_PER_CELL).bit_length()))
    hot = docs.sparkSession.sparkContext.broadcast(hot_cells(texts.select("text"), window, width))
    marked = stored(mark_candidates(texts.withColumn("rid", F.monotonically_increasing_id()).select("rid", "doc_id", "text"), hot, window, width))
    done = marked.where("kept_sha256 is not null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256")
    candidates = marked.where("kept_sha256 is null")
    return done.unionByName(without_covered(candidates, overestimated(candidates, window), window))


ORACLE = f"""
with d as (select doc_id, row_number() over () as r, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
win as (select r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') as s from (select r, w, unnest(range(1, len(w) - {WINDOW - 2})) as i from d)),
rep as (select s from win group by s having count(*) > 1),
gone as (select distinct r, i + k as i from (select r, i from win join rep using (s)), (select unnest(range({WINDOW})) as k)),
kept as (select x.r, string_agg(x.word, ' ' order by x.i) as text, count(*) as n from (select r, unnest(w) as word, generate_subscripts(w, 1) as i from d) x anti join gone on x.r = gone.r and x.i = gone.i group by x.r)
select d.doc_id, len(d.w)::bigint as n_words, (len(d.w) - coalesce(kept.n, 0))::bigint as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256 from d left join kept on d.r = kept.r
"""
