"""Operator 11: periodic runs of words in each text, and texts with each run cut to its first period.

A run is a stretch of words with smallest period q and a length of at least ``max(LEAST_LENGTH, 3 * q)`` that no neighbouring
word extends.  For each period the words q apart are compared on a grid so wide that any run's matches hold a grid point
(the grids' sizes add up as a harmonic series).  Where they agree, longest common extensions forwards and backwards give the
whole stretch; of equal stretches the smallest period counts.

Extensions are found with a difference cover: among any v residues two places have a common distance, below v, to places of
the cover.  The few words up to there are compared; only if all agree is the answer taken from the sorted suffixes that begin
at places of the cover (a fifth of all), as the least common prefix between two ranks, by a sparse table.  Suffixes are sorted
only for texts that come so far, by blocks of v words and then by doubling.

Texts of a batch are searched together, with a mark of its own between each two.  The work on a text of n words is about
n * log(n), and so is the memory of its task; a text is never split, as its runs may reach over all of it.

Defined results: a null text has no words; a null doc_id is never damaged; repeated rows are treated alike; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_batches, text_or_empty
from .words import BatchWords, texts_of

LEAST_LENGTH, LEAST_PERIODS = 24, 3
#: A perfect difference cover: every residue is the difference of two of these.
MODULUS, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Pairs of a grid that are compared at a time.
PAIRS = 1 << 22
#: Of each difference, a place x of the cover such that x + difference is in the cover too.
_MEETS = np.array([next(x for x in COVER if (x + d) % MODULUS in COVER) for d in range(MODULUS)])
RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class CoverSuffixes:
    """Ranks of the suffixes at places of the cover and the common prefixes of neighbours, for the texts of ``wanted``.

    ``symbols`` holds texts with marks between that occur once; ``text`` is the number of each place's text.
    """

    def __init__(self, symbols: np.ndarray, text: np.ndarray, wanted: np.ndarray):
        self.wanted = wanted
        in_cover = np.zeros(MODULUS, bool)
        in_cover[list(COVER)] = True
        places = np.flatnonzero(wanted[text] & in_cover[np.arange(len(symbols)) % MODULUS])
        self.index = np.full(len(symbols) + 1, -1, np.int64)  # the last one stands for all places beyond the end
        self.index[places] = np.arange(len(places))
        padded = np.concatenate([symbols, np.zeros(MODULUS, symbols.dtype)]).astype(np.int64)
        order, ranks = self._sorted(self._blocks(padded, places, int(symbols.max(initial=0))) + [text[places]])
        levels, step = [], MODULUS
        while len(ranks) and ranks.max() + 1 < len(ranks):
            following = self.index[np.minimum(places + step, len(symbols))]
            levels.append((step, ranks, following))
            order, ranks = self._sorted([np.where(following < 0, -1, ranks[following]), ranks])
            step *= 2
        self.rank = np.empty(len(places), np.int64)
        self.rank[order] = np.arange(len(places))
        self.table = [self._neighbours(padded, places, order, levels)]
        while 2 << (len(self.table) - 1) <= len(self.table[0]):
            half = 1 << (len(self.table) - 1)
            self.table.append(np.minimum(self.table[-1][:-half], self.table[-1][half:]))

    @staticmethod
    def _blocks(padded: np.ndarray, places: np.ndarray, most: int) -> list[np.ndarray]:
        """The MODULUS symbols from each place, several in an integer; the last ones first, as ``lexsort`` wants them."""
        bits = max(1, most.bit_length())
        per = min(MODULUS, 63 // bits)
        keys = []
        for at in range(0, MODULUS, per):
            key = np.zeros(len(places), np.int64)
            for k in range(at, min(at + per, MODULUS)):
                key = (key << bits) | padded[places + k]
            keys.append(key)
        return keys[::-1]

    @staticmethod
    def _sorted(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Order by the keys (the last one counts first), and ranks that are equal where all keys are."""
        order = np.lexsort(keys)
        new = np.zeros(len(order), bool)
        for key in keys:
            new[1:] |= key[order[1:]] != key[order[:-1]]
        ranks = np.empty(len(order), np.int64)
        ranks[order] = np.cumsum(new)
        return order, ranks

    @staticmethod
    def _neighbours(padded: np.ndarray, places: np.ndarray, order: np.ndarray, levels: list) -> np.ndarray:
        """Length of the common prefix of each suffix and the next one in order."""
        a, b = order[:-1].copy(), order[1:].copy()
        found = np.zeros(len(a), np.int64)
        alive = np.ones(len(a), bool)
        for step, ranks, following in reversed(levels):
            same = alive & (ranks[a] == ranks[b])
            found[same] += step
            a[same], b[same] = following[a[same]], following[b[same]]
            alive &= (a >= 0) & (b >= 0)
        left = np.flatnonzero(alive)
        x, y = places[a[left]], places[b[left]]
        for k in range(MODULUS):
            same = padded[x + k] == padded[y + k]
            left, x, y = left[same], x[same], y[same]
            found[left] += 1
        return found

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common prefix of the suffixes at two different places of the cover."""
        a, b = self.rank[self.index[i]], self.rank[self.index[j]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(float))[1] - 1
        out = np.empty(len(i), np.int64)
        for k in np.unique(level):
            of = level == k
            out[of] = np.minimum(self.table[k][low[of]], self.table[k][high[of] - (1 << int(k))])
        return out


class Extensions:
    """Longest common extensions between places of the same text."""

    def __init__(self, symbols: np.ndarray, text: np.ndarray):
        self.symbols, self.text = symbols, text
        self.suffixes: CoverSuffixes | None = None

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from ``i`` and ``j`` (before it) on agree."""
        apart = (_MEETS[(j - i) % MODULUS] - i) % MODULUS
        found, left = np.zeros(len(i), np.int64), np.arange(len(i))
        reached = []
        for k in range(MODULUS):  # the few words up to the cover
            there = apart[left] == k
            reached.append(left[there])
            left = left[~there]
            left = left[self.symbols[i[left] + k] == self.symbols[j[left] + k]]
            found[left] += 1
        met = np.concatenate(reached)
        if len(met):
            found[met] += self._suffixes(self.text[i[met]]).common(i[met] + apart[met], j[met] + apart[met])
        return found

    def _suffixes(self, texts: np.ndarray) -> CoverSuffixes:
        if self.suffixes is None or not self.suffixes.wanted[texts].all():
            wanted = np.zeros(int(self.text.max()) + 1, bool) if self.suffixes is None else self.suffixes.wanted.copy()
            wanted[texts] = True
            self.suffixes = CoverSuffixes(self.symbols, self.text, wanted)
        return self.suffixes


def _grid(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text, place in it, period: for each period the places of a grid that no run's matches can miss."""
    texts = np.flatnonzero(sizes >= LEAST_LENGTH)
    periods = sizes[texts] // LEAST_PERIODS
    ends = np.cumsum(periods)
    total, at = int(ends[-1]) if len(ends) else 0, 0
    while at < total:
        row = np.arange(at, min(at + PAIRS, total))
        which = np.searchsorted(ends, row, side="right")
        text, period = texts[which], row - (ends - periods)[which] + 1
        step = np.maximum(LEAST_LENGTH, LEAST_PERIODS * period) - period
        count = (sizes[text] - period - 1) // step + 1
        upto = np.cumsum(count)
        n = max(1, int(np.searchsorted(upto, PAIRS)))
        text, period, step, count, upto = text[:n], period[:n], step[:n], count[:n], upto[:n]
        at += n
        place = (np.arange(int(upto[-1])) - np.repeat(upto - count, count)) * np.repeat(step, count)
        yield np.repeat(text, count), place, np.repeat(period, count)


def periodic_runs(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Runs of texts whose words' codes stand one after another: rows of text, start, length, period, by text, start and period."""
    n = len(sizes)
    if not len(codes):
        return np.zeros((0, 4), np.int64)
    # each text stands between two marks; the one that ends it, in the direction of search, counts as its own
    firsts = np.cumsum(sizes) - sizes + np.arange(n) + 1
    text = np.repeat(np.arange(n), sizes + 1)
    end = len(text)
    symbols = np.zeros(end + 1, np.int32)
    marks = np.append(firsts - 1, end)
    is_word = np.ones(end + 1, bool)
    is_word[marks] = False
    symbols[is_word] = codes
    symbols[marks] = int(codes.max()) + 1 + np.arange(n + 1)
    ahead, back = Extensions(symbols, np.append(0, text)), Extensions(symbols[::-1].copy(), np.append(text, n - 1)[::-1].copy())
    found = [np.zeros((0, 4), np.int64)]
    for of, place, period in _grid(sizes):
        i = firsts[of] + place
        same = symbols[i] == symbols[i + period]
        of, i, period = of[same], i[same], period[same]
        forwards = ahead.of(i, i + period)
        # in the reversed texts the place before i + period comes first
        backwards = back.of(end - (i - 1), end - (i + period - 1))
        matches = forwards + backwards
        long = matches >= np.maximum(LEAST_LENGTH, LEAST_PERIODS * period) - period
        rows = np.stack([of, i - backwards - firsts[of], matches + period, period], axis=1)[long]
        found.append(np.unique(rows, axis=0))
    rows = np.unique(np.concatenate(found), axis=0)
    smallest = np.ones(len(rows), bool)
    smallest[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    rows = rows[smallest]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def damage(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which word stands at each place of a damaged text of n words; None if it stays as it is."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    out = np.arange(n)
    out[a:] = a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
    return out


def _answer(joined: bytes, moved: np.ndarray | None, n: int, runs: np.ndarray) -> tuple:
    """n_runs, the run of greatest exponent, the hash of all runs and that of the collapsed text."""
    if moved is None and not len(runs):
        return 0, None, None, None, None, hashlib.sha256(b"").hexdigest(), hashlib.sha256(joined).hexdigest()
    words = joined.split(b" ")
    if moved is not None:
        words = [words[k] for k in moved.tolist()]
    steps = np.zeros(n + 1, np.int64)
    listed = runs.tolist()
    for start, length, period in listed:
        steps[start + period] += 1
        steps[start + length] -= 1
    gone = np.cumsum(steps[:n]) > 0
    collapsed = b" ".join(w for w, x in zip(words, gone.tolist()) if not x)
    best = min(listed, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if listed else [None] * 3
    text = "".join(f"{s},{k},{q}\n" for s, k, q in listed)
    return len(listed), *best, 1000 * best[1] // best[2] if listed else None, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest()


def find_runs(docs: DataFrame, damaged: bool = True) -> DataFrame:
    """Per document: the number of runs, the one of greatest exponent, and hashes of all runs and of the collapsed text."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, ids = BatchWords(texts_of(batch["text"])), batch["doc_id"].to_pylist()
            codes, sizes = words.codes.copy(), words.sizes
            moves = [damage(i, n) if damaged else None for i, n in zip(ids, sizes.tolist())]
            for at, moved in zip(words.bounds.tolist(), moves):
                if moved is not None:
                    codes[at : at + len(moved)] = codes[at + moved]
            runs = periodic_runs(codes, sizes)
            cuts = np.searchsorted(runs[:, 0], np.arange(len(ids) + 1))
            rows = [(i, *_answer(t, m, n, runs[a:b, 1:])) for i, t, m, n, a, b in zip(ids, words.joined, moves, sizes.tolist(), cuts[:-1], cuts[1:])]
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in RESULT.split(", ")])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text")), search, RESULT)
