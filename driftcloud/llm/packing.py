"""Operator 5: best-two-fit packing of token sequences.

Documents become pieces of at most ``capacity`` tokens.  Pieces are dealt by a hash of their row into groups of about
``group_pieces``, whose number follows the data, and each group is packed by one task; a group's only loss against
packing everything at once is its last bin or two.  A bin is filled greedily, longest piece first; then its smallest
piece gives way to two unpacked pieces if these fill the gap, grown by that piece, more tightly.

Defined results: a null text is an empty one, whose only token is the end id; rows with equal or null doc_ids are packed
as separate documents; no documents give no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_batches, stored, text_or_empty
from .token_cache import TOKEN_BATCH, encoder

CAPACITY, GROUP_PIECES = 4096, 20_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of each document's ids and its end id: doc_id, piece, start, length, ids_crc32."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bounds = encoder(tokenizer_path).encode(batch["text"])
            rows = []
            for doc_id, a, b in zip(batch["doc_id"].to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                raw = ids[a:b].astype("<u4", copy=False).tobytes() + end
                for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), text_or_empty("text").alias("text")), cut, PIECES, rows=TOKEN_BATCH)


def best_two_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length (1 to capacity)."""
    pool: dict[int, list[int]] = defaultdict(list)
    for i in range(len(lengths) - 1, -1, -1):
        pool[lengths[i]].append(i)  # the first of a length is taken first
    free = sum(1 << n for n in pool)  # bit n: a piece of length n is unpacked

    def longest(most: int) -> int:
        return (free & ((1 << (most + 1)) - 1)).bit_length() - 1

    def take(n: int) -> int:
        nonlocal free
        i = pool[n].pop()
        if not pool[n]:
            free &= ~(1 << n)
        return i

    bins, offsets, current = [0] * len(lengths), [0] * len(lengths), 0
    while free:
        chosen, gap = [], capacity
        while (n := longest(gap)) > 0:
            chosen.append(take(n))
            gap -= n
        smallest = lengths[chosen[-1]]
        if gap and free:
            room, best, pair = gap + smallest, smallest, None
            a = longest(room - 1)
            while a > 0 and 2 * a > best and best < room:
                b = longest(min(a, room - a))
                if b == a and len(pool[a]) < 2:
                    b = longest(a - 1)
                if b > 0 and a + b > best:
                    best, pair = a + b, (a, b)
                a = longest(a - 1)
            if pair:
                i = chosen.pop()
                pool[smallest].append(i)
                free |= 1 << smallest
                chosen += [take(pair[0]), take(pair[1])]
        at = 0
        for i in chosen:
            bins[i], offsets[i] = current, at
            at += lengths[i]
        current += 1
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """The pieces (doc_id, piece, length and any other columns) with sequence_id and offset."""
    groups = max(1, -(-pieces.count() // group_pieces))
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))  # by row, so that equal or missing ids spread

    def one_group(rows: pa.Table) -> pa.Table:  # Arrow keeps ids as they are where some are null
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bins, offsets = best_two_fit(rows["length"].to_pylist(), capacity)
        sequence = (rows["_group"][0].as_py() << 32) + np.array(bins, np.int64)
        return rows.drop_columns(["_group"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offsets, pa.int64()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return dealt.groupBy("_group").applyInArrow(one_group, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(stored(token_pieces(docs, tokenizer_path, end_id, capacity)), capacity, group_pieces)
