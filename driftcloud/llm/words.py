"""Words of whole batches of texts as integers: what operators over word sequences share.

A word is a run of characters outside ``[\\x20\\x09-\\x0D]``; all of these are single bytes in UTF-8, so texts are split as bytes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash


class BatchWords:
    """The words of some texts, one after another: each text's words joined by a blank, the bounds of its words, codes and distinct words."""

    def __init__(self, texts: list[bytes]):
        self.joined = [b" ".join(t.split()) for t in texts]
        filled = [t for t in self.joined if t]
        lists = pc.split_pattern(pa.array(filled, pa.binary()).cast(pa.large_string()), " ")
        sizes = np.zeros(len(texts), np.int64)
        sizes[[i for i, t in enumerate(self.joined) if t]] = np.diff(lists.offsets.to_numpy()) if filled else []
        self.bounds = np.concatenate([[0], np.cumsum(sizes)])
        coded = lists.flatten().dictionary_encode()
        self.codes, self.distinct = coded.indices.to_numpy(), coded.dictionary

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.bounds)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return np.fromiter(map(xxhash.xxh3_64_intdigest, self.distinct.cast(pa.large_binary()).to_pylist()), np.uint64, len(self.distinct))[self.codes]


def texts_of(column: pa.Array) -> list[bytes]:
    """Texts as bytes; nulls are empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit integers, so that each bit depends on all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class RangeHashes:
    """Polynomial hashes (modulo 2 to the 64th, of an odd base) of any stretch of a sequence of hashes."""

    def __init__(self, hashes: np.ndarray, base: int):
        room = 1 << max(12, int(len(hashes) + 1).bit_length())  # few sizes, so that powers are reused
        self.inverse = _powers(pow(base, -1, 1 << 64), room)
        self.sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * _powers(base, room)[: len(hashes)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.inverse[starts]

    def of_length(self, n: int) -> np.ndarray:
        """Of every stretch of n."""
        k = len(self.sums) - n
        return (self.sums[n:] - self.sums[:k]) * self.inverse[:k] if k > 0 else np.zeros(0, np.uint64)


def sliding(fold: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    """``fold`` (minimum or maximum) over every ``width`` values, by doubling."""
    if len(values) < width:
        return values[:0]
    size = 1
    while 2 * size <= width:
        values = fold(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return fold(values[: len(values) - rest], values[rest:]) if rest else values
