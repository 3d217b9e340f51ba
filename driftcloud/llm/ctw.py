"""Operator 8: language-model scores by context-tree weighting over bytes, beside a unigram base.

A text is its tokens: words (A-Z lower-cased) and an end.  The model sees the bytes of the words with one blank between
them and a line end after the last, after ``DEPTH`` line ends.  Each byte is eight binary decisions; each decision has a context
tree over the last ``DEPTH`` bytes, whose nodes mix their Krichevsky-Trofimov estimate with what their children say, by the
weights of context-tree weighting.  Every context that occurs is a node, however rare; nothing is folded away at any size.

Texts are read in slices of ``SLICE_BYTES`` and gathered in blocks of about ``BLOCK_BYTES``.  A block gives its distinct strings of
DEPTH + 1 bytes and its distinct words, with their counts in training texts, packed by shard: the last two bytes of the
context, or a hash of the word.  All that a context tree has below a shard's two bytes is in that shard, so one task sums
a shard's counts and mixes its depths 2 to DEPTH; the 256 contexts of one byte and the root (a fixed bound) are mixed on the
driver.  Each block gets its strings' probabilities and its words' counts back from the shards, and texts are scored block by block.
Shards are salted by block where blocks are many, first for the sums, then for the way back; a task holds the distinct strings
of one shard, or of one block.

A document is held out if crc32 of its id as text, modulo 5, is 1.  Defined results: a null text is an empty one (its end
token is scored); a null id counts as the text ''; repeated rows are scored each on their own, and equal texts have equal
scores; an empty table gives no rows; without training documents every count is 0 and every decision is even; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from math import log, log10, pi

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from .common import map_batches, stored, text_or_empty

DEPTH = 5
SLICE_BYTES, BLOCK_BYTES = 1 << 20, 16 << 20
WORD_SHARDS, BLOCKS_A_SALT = 256, 512
#: Strings of one shard that are mixed at a time (more where one context of three bytes has more).
MIXED_AT_ONCE = 50_000
GRAMS, WORDS, TEXTS = 0, 1, 2
_BREAK = re.compile(rb"[\x20\x09-\x0d]")
_PARTS = "block long, kind int, shard int, items binary, counts binary, doc_id long, held_out boolean, text string"


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1


def _slices(text: str) -> Iterator[list[bytes]]:
    """The words of a text, some at a time; at least one list, which may be empty."""
    raw, at = text.encode().lower(), 0  # ASCII letters only
    while True:
        cut = _BREAK.search(raw, at + SLICE_BYTES) if len(raw) - at > SLICE_BYTES else None
        yield raw[at : cut.start() if cut else len(raw)].split()  # ASCII white space only
        if not cut:
            return
        at = cut.end()


class Reader:
    """Collects the bytes that the model sees, so that many short texts are worked on together."""

    def __init__(self) -> None:
        self.parts: list[bytes] = []
        self.of: list[int] = []
        self.sizes: list[int] = []
        self.held = 0

    def add(self, n: int, before: bytes, own: bytes) -> bytes:
        """Bytes ``own`` of text ``n`` after the DEPTH bytes ``before``; returns the last DEPTH of both."""
        self.parts += (before, own)
        self.of.append(n)
        self.sizes.append(len(own))
        self.held += len(own)
        return (before + own[-DEPTH:])[-DEPTH:]

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each own byte with its context as one number, the context's last byte highest and the byte itself lowest; the text
        of each part and the place of its first number.  Empties the reader."""
        data, sizes, of = np.frombuffer(b"".join(self.parts), np.uint8).astype(np.int64), np.array(self.sizes), np.array(self.of)
        first = np.cumsum(sizes) - sizes
        at = np.arange(len(data) - DEPTH * len(sizes)) + np.repeat(DEPTH * np.arange(1, len(sizes) + 1), sizes)
        out = data[at]
        for k in range(1, DEPTH + 1):
            out |= data[at - k] << 8 * (DEPTH + 1 - k)
        self.__init__()
        return out, of, first


def _read(reader: Reader, n: int, text: str) -> Iterator[list[bytes]]:
    """Adds a text to the reader, yielding its words after each slice."""
    before, first = b"\n" * DEPTH, True
    for words in _slices(text):
        own = b" ".join(words)
        if words and not first:
            own = b" " + own
        first = first and not words
        if own:
            before = reader.add(n, before, own)
        yield words
    reader.add(n, before, b"\n")


def _summed(values: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, and the sums of their times."""
    if len(values) == 1:
        return values[0], times[0]
    found, where = np.unique(np.concatenate(values), return_inverse=True)
    return found, np.bincount(where, np.concatenate(times), len(found)).astype(np.int64)  # exact below 2**53


def _squeezed(values: np.ndarray, ascending: bool = False) -> bytes:
    """Integers, or the steps between ascending ones, by planes of bytes, of which the high ones are mostly zero."""
    steps = np.diff(values, prepend=values.dtype.type(0)) if ascending else values
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(len(steps), -1).T).tobytes())


def _unsqueezed(data: bytes, kind: str, ascending: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    values = np.ascontiguousarray(planes.T).view(kind).ravel()
    return np.cumsum(values, dtype=kind) if ascending else values


def _part(n: int, schema: str, **columns: pa.Array) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}
    named = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([columns[c].cast(types[t]) if c in columns else pa.nulls(n, types[t]) for c, t in named], [c for c, _ in named])


class Block:
    """Distinct strings and words of some texts with their counts in training texts."""

    def __init__(self) -> None:
        self.grams: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.words: Counter[bytes] = Counter()
        self.unseen: set[bytes] = set()
        self.bytes = self.pending = 0

    def add(self, reader: Reader, out: list[bool]) -> None:
        self.bytes += reader.held
        grams, of, first = reader.grams()
        ends = np.append(first[1:], len(grams))
        kept = np.repeat(~np.array(out)[of], ends - first)
        for mine, weight in ((grams[kept], 1), (grams[~kept], 0)):
            if len(mine):
                found, n = np.unique(mine, return_counts=True)
                self.grams.append(found)
                self.times.append(n * weight)
                self.pending += len(found)
        if self.pending > 4_000_000 and len(self.grams) > 1:
            found, n = _summed(self.grams, self.times)
            self.grams, self.times, self.pending = [found], [n], 0

    def rows(self, block: int) -> Iterator[pa.RecordBatch]:
        grams, times = _summed(self.grams, self.times)
        shards = (grams >> 32).astype(np.int32)
        cuts = np.append(np.flatnonzero(np.diff(shards, prepend=-1)), len(grams))
        low = grams.astype("<u4")
        packed = [(GRAMS, int(shards[a]), _squeezed(low[a:b], True), _squeezed(times[a:b])) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        dealt: dict[int, list[bytes]] = {}
        for word in (*self.words, *(self.unseen - self.words.keys())):
            dealt.setdefault(zlib.crc32(word) % WORD_SHARDS, []).append(word)
        packed += [(WORDS, shard, b" ".join(words), _squeezed(np.array([self.words[w] for w in words], np.int64))) for shard, words in dealt.items()]
        for at in range(0, len(packed), 1024):
            kinds, which, items, counts = zip(*packed[at : at + 1024])
            yield _part(len(kinds), _PARTS, block=pa.array([block] * len(kinds)), kind=pa.array(kinds), shard=pa.array(which), items=pa.array(items), counts=pa.array(counts))


def gather_counts(rows: DataFrame) -> DataFrame:
    """The stored blocks: packed strings and words by shard, and the texts themselves."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, block, reader = TaskContext.get().partitionId() << 32, Block(), Reader()
        for batch in batches:
            out, texts, at = batch["held_out"].to_pylist(), batch["text"], 0
            for n in range(batch.num_rows):
                for words in _read(reader, n, texts[n].as_py()):
                    if out[n]:
                        block.unseen.update(words)
                    else:
                        block.words.update(words)
                    if reader.held >= SLICE_BYTES:
                        block.add(reader, out)
                if block.bytes + reader.held >= BLOCK_BYTES or n + 1 == batch.num_rows:
                    block.add(reader, out)
                    yield _part(n + 1 - at, _PARTS, block=pa.array([number] * (n + 1 - at)), kind=pa.array([TEXTS] * (n + 1 - at)), **{c: batch[c].slice(at, n + 1 - at) for c in ("doc_id", "held_out", "text")})
                    at = n + 1
                    if block.bytes >= BLOCK_BYTES:
                        yield from block.rows(number)
                        number, block = number + 1, Block()
        if block.bytes:
            yield from block.rows(number)

    return stored(map_batches(rows, gather, _PARTS, rows=1024))


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a block with these counts."""

    def gamma(x: np.ndarray) -> np.ndarray:  # Stirling's series, six above
        y = x + 6
        shift = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5)
        return (y - 0.5) * np.log(y) - y + 0.5 * log(2 * pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)

    return np.where(zeros + ones == 0, 0.0, gamma(zeros + 0.5) + gamma(ones + 0.5) - gamma(zeros + ones + 1.0) - log(pi))


class Level:
    """Nodes of one depth: counts, log of the weighted probability, and what the estimate and the depths below say of a one or a zero."""

    def __init__(self, zeros: np.ndarray, ones: np.ndarray, inner: np.ndarray | None = None):
        own = _log_kt(zeros, ones)
        self.zeros, self.ones = zeros, ones
        self.weighted = own if inner is None else np.logaddexp(own, inner) + log(0.5)
        weight = np.ones(len(own)) if inner is None else np.exp(log(0.5) + own - self.weighted)
        total = zeros + ones + 1.0
        self.one, self.zero, self.rest = weight * (ones + 0.5) / total, weight * (zeros + 0.5) / total, 1 - weight

    def parents(self, of: np.ndarray, n: int) -> Level:
        """The depth above, of whose ``n`` nodes each node here has the one at ``of``."""
        return Level(np.bincount(of, self.zeros, n), np.bincount(of, self.ones, n), np.bincount(of, self.weighted, n))


def mix_shard(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, Level, np.ndarray]:
    """For a shard's strings (sorted; the shard's two bytes left out): the probability of each of the eight bits of each string's
    last byte after those before it, mixed over depths 2 to DEPTH (one row a string); the nodes of depth 2 and their places in the bytes' heap."""
    third = grams >> 8 * (DEPTH - 2)
    edges = np.append(np.flatnonzero(np.diff(third, prepend=-1)), len(grams)).tolist()
    out, tops, at = np.empty((len(grams), 8)), [], 0
    while at < len(grams):
        end = next((e for e in edges if e >= at + MIXED_AT_ONCE), len(grams))
        tops.append(_mix_below(grams[at:end], counts[at:end], out[at:end]))
        at = end
    nodes, where = np.unique(np.concatenate([n for n, _ in tops]), return_inverse=True)
    zeros, ones, weighted = (np.bincount(where, np.concatenate([getattr(level, f) for _, level in tops]), len(nodes)) for f in ("zeros", "ones", "weighted"))
    top = Level(zeros, ones, weighted)
    byte = grams & 255
    for k in range(8):
        place = np.searchsorted(nodes, (256 | byte) >> (k + 1))
        out[:, k] = np.where(byte >> k & 1, top.one[place], top.zero[place]) + top.rest[place] * out[:, k]
    return out, top, nodes


def _mix_below(grams: np.ndarray, counts: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, Level]:
    """Depths 3 to DEPTH of whole contexts of three bytes: fills ``out`` and returns the nodes of depth 3 with their places in the heap."""
    byte, k = grams & 255, np.arange(8)
    bits = (byte[:, None] >> k & 1).astype(bool)
    codes, of = np.unique(((grams & ~255)[:, None] | ((256 | byte)[:, None] >> (k + 1))).ravel(), return_inverse=True)
    weights = np.repeat(counts, 8).astype(float)
    level = Level(np.bincount(of, weights * ~bits.ravel(), len(codes)), np.bincount(of, weights * bits.ravel(), len(codes)))
    levels, up = [level], []
    for _ in range(DEPTH - 3):
        codes, parent = np.unique(codes >> 16 << 8 | codes & 255, return_inverse=True)
        up.append(parent)
        level = level.parents(parent, len(codes))
        levels.append(level)
    one, zero, rest = levels[-1].one, levels[-1].zero, levels[-1].rest
    for level, parent in zip(reversed(levels[:-1]), reversed(up)):
        one, zero, rest = one[parent] + rest[parent] * level.one, zero[parent] + rest[parent] * level.zero, rest[parent] * level.rest
    out[:] = np.where(bits, one[of].reshape(-1, 8), zero[of].reshape(-1, 8))
    return codes & 255, levels[-1]


_PACKED = "kind int, shard int, items binary, counts binary"
_TABLE = _PACKED + ", nodes binary, n_train long, n_distinct long"


def _by_shard(packed: DataFrame, keys: list[str], schema: str, finish: Callable[[int, int, object, np.ndarray], pa.RecordBatch]) -> DataFrame:
    """Sums the packed counts of each shard (and salt) and gives what ``finish`` makes of its kind, number, distinct items and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, grams, times, pending, words = None, [], [], 0, {}
        for batch in batches:
            for *at, items, counts in zip(*(batch[c].to_pylist() for c in keys), batch["items"], batch["counts"]):
                if key is not None and at != key:
                    yield finish(*key[:2], *(_summed(grams, times) if key[0] == GRAMS else (list(words), np.fromiter(words.values(), np.int64, len(words)))))
                    grams, times, pending, words = [], [], 0, {}
                key, n = at, _unsqueezed(counts.as_py(), "<i8")
                if key[0] == GRAMS:
                    grams.append(_unsqueezed(items.as_py(), "<u4", True).astype(np.int64))
                    times.append(n)
                    pending += len(n)
                    if pending > 2 * len(grams[0]) + 1_000_000:
                        grams, times = ([x] for x in _summed(grams, times))
                        pending = len(grams[0])
                else:
                    for word, c in zip(items.as_py().split(b" "), n.tolist()):
                        words[word] = words.get(word, 0) + c
        if key is not None:
            yield finish(*key[:2], *(_summed(grams, times) if key[0] == GRAMS else (list(words), np.fromiter(words.values(), np.int64, len(words)))))

    return map_batches(packed.repartition(*keys).sortWithinPartitions(*keys), run, schema)


def _pack(items: object) -> bytes:
    return b" ".join(items) if isinstance(items, list) else _squeezed(items.astype("<u4"), True)


def shard_tables(packed: DataFrame) -> DataFrame:
    """The stored tables of all shards: strings with the probabilities of their bits (and their nodes of depth 2), words with their counts."""

    def summed(kind: int, shard: int, items: object, counts: np.ndarray) -> pa.RecordBatch:
        return _part(1, _PACKED, kind=pa.array([kind]), shard=pa.array([shard]), items=pa.array([_pack(items)]), counts=pa.array([_squeezed(counts)]))

    def table(kind: int, shard: int, items: object, counts: np.ndarray) -> pa.RecordBatch:
        mine = {"kind": pa.array([kind]), "shard": pa.array([shard]), "items": pa.array([_pack(items)])}
        if kind == WORDS:
            return _part(1, _TABLE, **mine, counts=pa.array([_squeezed(counts)]), n_train=pa.array([int(counts.sum())]), n_distinct=pa.array([int((counts > 0).sum())]))
        bits, top, nodes = mix_shard(items, counts)
        return _part(1, _TABLE, **mine, counts=pa.array([bits.tobytes()]), nodes=pa.array([np.stack([nodes.astype(float), top.zeros, top.ones, top.weighted]).tobytes()]))

    if packed.where("salt > 0").isEmpty():
        sums = packed.select("kind", "shard", "items", "counts")
    else:
        sums = _by_shard(packed, ["kind", "shard", "salt"], _PACKED, summed)
    return stored(_by_shard(sums, ["kind", "shard"], _TABLE, table))


def upper_mixture(tables: DataFrame) -> np.ndarray:
    """What the root and the contexts of one byte say: for each such context and node of the heap the parts of a one and of a zero, and
    the weight left to the depths below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for last, raw in zip(batch["last"].to_pylist(), batch["nodes"]):
                nodes, *values = np.frombuffer(raw.as_py()).reshape(4, -1)
                sums.setdefault(last, np.zeros((3, 256)))[:, nodes.astype(int)] += values
        for last, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["last", "sums"])

    of_last = tables.where(F.col("kind") == GRAMS).select(F.shiftright("shard", 8).alias("last"), "nodes").repartition("last")
    out, seen, first = np.zeros((3, 256, 256)), [], np.zeros((3, 256))
    levels = []
    for row in map_batches(of_last, run, "last int, sums binary").orderBy("last").collect():  # 256 rows at most
        zeros, ones, weighted = np.frombuffer(row.sums).reshape(3, 256)
        level = Level(zeros, ones, weighted)
        seen.append(row.last)
        levels.append(level)
        first += (zeros, ones, level.weighted)
    root = Level(*first)
    for last, level in zip(seen, levels):
        out[:, last] = root.one + root.rest * level.one, root.zero + root.rest * level.zero, root.rest * level.rest
    return out


_VALUES = "block long, kind int, shard int, items binary, values binary"


def block_values(packed: DataFrame, tables: DataFrame, upper: np.ndarray) -> DataFrame:
    """Each block's strings with log10 of the probability of their last byte, and its words with their counts."""
    shared = packed.sparkSession.sparkContext.broadcast(upper)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = values = None
        for batch in batches:
            rows = []
            for block, kind, shard, items, counts in zip(*(batch[c].to_pylist() for c in ("block", "kind", "shard", "items", "counts"))):
                if block is None:  # a shard's table stands before its blocks
                    if kind == WORDS:
                        known = dict(zip(items.split(b" "), _unsqueezed(counts, "<i8").tolist()))
                        continue
                    known = _unsqueezed(items, "<u4", True)
                    values = np.zeros(len(known))
                    bits, byte = np.frombuffer(counts).reshape(-1, 8), (known & 255).astype(np.int64)
                    ones, zeros, rest = shared.value[:, shard >> 8]
                    for k in range(8):
                        node = (256 | byte) >> (k + 1)
                        values += np.log10(np.where(byte >> k & 1, ones[node], zeros[node]) + rest[node] * bits[:, k])
                elif kind == WORDS:
                    rows.append((block, kind, shard, items, _squeezed(np.array([known[w] for w in items.split(b" ")], np.int64))))
                else:
                    rows.append((block, kind, shard, items, values[np.searchsorted(known, _unsqueezed(items, "<u4", True))].tobytes()))
            if rows:
                yield _part(len(rows), _VALUES, **{c.split()[0]: pa.array(x) for c, x in zip(_VALUES.split(", "), zip(*rows))})

    first = tables.select(F.lit(None).cast("long").alias("block"), "kind", "shard", "items", "counts").join(packed.select("kind", "shard", "salt").distinct(), ["kind", "shard"])
    both = first.select("block", "kind", "shard", "salt", "items", "counts").unionByName(packed.select("block", "kind", "shard", "salt", "items", F.lit(None).cast("binary").alias("counts")))
    keys = ["kind", "shard", "salt"]
    return map_batches(both.repartition(*keys).sortWithinPartitions(*keys, F.col("block").asc_nulls_first()), run, _VALUES, rows=256)


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, bits_per_byte double"


def score_blocks(parts: DataFrame, n_train: int, n_distinct: int, n_texts: int) -> DataFrame:
    """The texts' scores, from each block's strings and words (rows of _VALUES) followed by its texts."""
    denominator = n_train + 0.5 * (n_distinct + 1)
    end = log10((n_texts + 0.5) / denominator)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, strings, logs, grams, values, bases, unknown = None, [], [], None, None, {}, set()
        for batch in batches:
            block, kind, n = batch["block"].to_pylist(), batch["kind"].to_pylist(), 0
            while n < len(kind):
                if block[n] != current:
                    current, strings, logs, bases, unknown, grams = block[n], [], [], {}, set(), None
                if kind[n] == GRAMS:
                    strings.append(_unsqueezed(batch["items"][n].as_py(), "<u4", True).astype(np.int64) | batch["shard"][n].as_py() << 32)
                    logs.append(np.frombuffer(batch["values"][n].as_py()))
                    n += 1
                elif kind[n] == WORDS:
                    for word, c in zip(batch["items"][n].as_py().split(b" "), _unsqueezed(batch["values"][n].as_py(), "<i8").tolist()):
                        bases[word] = log10((c + 0.5) / denominator)
                        if not c:
                            unknown.add(word)
                    n += 1
                else:
                    last = n
                    while last < len(kind) and block[last] == current:
                        last += 1
                    if grams is None:
                        grams, values = np.concatenate(strings), np.concatenate(logs)
                        strings, logs = [], []
                    yield score(batch.slice(n, last - n), grams, values, bases, unknown)
                    n = last

    def score(batch: pa.RecordBatch, grams: np.ndarray, values: np.ndarray, bases: dict[bytes, float], unknown: set[bytes]) -> pa.RecordBatch:
        n, reader = batch.num_rows, Reader()
        tokens, known, base, scores, sizes = [1] * n, [int(n_texts > 0)] * n, [end] * n, np.zeros(n), np.zeros(n, np.int64)

        def settle() -> None:
            mine, of, first = reader.grams()
            found, where = np.unique(mine, return_inverse=True)
            np.add.at(scores, of, np.add.reduceat(values[np.searchsorted(grams, found)][where], first))
            np.add.at(sizes, of, np.diff(np.append(first, len(mine))))

        for i in range(n):
            for words in _read(reader, i, batch["text"][i].as_py()):
                tokens[i] += len(words)
                base[i] += sum(map(bases.__getitem__, words))
                known[i] += len(words) - (sum(map(unknown.__contains__, words)) if unknown else 0)
                if reader.held >= SLICE_BYTES:
                    settle()
        if reader.held:
            settle()
        return pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["held_out"], pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(scores), pa.array(-scores / log10(2) / sizes)], [c.split()[0] for c in _SCORES.split(", ")]
        )

    return map_batches(parts.repartition("block").sortWithinPartitions("block", "kind", "shard"), run, _SCORES, rows=256)


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    gathered = gather_counts(docs.select(F.col("doc_id").cast("long"), text_or_empty("text").alias("text"), held_out().alias("held_out")))
    texts = gathered.where(F.col("kind") == TEXTS)
    n_blocks, n_texts = texts.agg(F.count_distinct("block"), F.count(F.when(~F.col("held_out"), 1))).first()
    salt = F.pmod(F.xxhash64("block"), F.lit(max(1, -(-n_blocks // BLOCKS_A_SALT)))).cast("int")
    packed = gathered.where(F.col("kind") != TEXTS).select("block", "kind", "shard", salt.alias("salt"), "items", "counts")
    tables = shard_tables(packed)
    n_words, n_distinct = tables.agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.coalesce(F.sum("n_distinct"), F.lit(0))).first()
    n_train = n_words + n_texts
    values = block_values(packed, tables, upper_mixture(tables))
    parts = values.unionByName(texts.select("block", "kind", "doc_id", "held_out", "text"), allowMissingColumns=True)
    out = score_blocks(parts, n_train, n_distinct + (n_texts > 0), n_texts)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte")
