"""Operator 3: SentencePiece encoding and decoding by streaming Viterbi.

Pieces and their scores come from a model file; the best segmentation has the greatest sum of scores (ties: the longer
last piece).  The lattice is walked boundary by boundary; from each, a tree of the pieces gives those that start there, which
needs no more characters ahead than the longest piece has.  Whenever all surviving backpointer paths converge on one
boundary, the ids before it are committed and all that lies before it is forgotten, so memory doesn't grow with the text.
Characters that no piece covers fall back to byte pieces.

Every text goes through this one search.  No piece leads over the boundary before a blank, nor (in models whose pieces never
join them) over that between a letter and punctuation, so all paths meet there.  After a commit at such a boundary the
search is in its first state again: what it commits up to the next one depends on the characters between them alone, and a
worker keeps these ids for the parts met lately and walks each part once.

Only the model's scores decide: for a model trained by merges, the result is the best path over its scores, not the merge
order's.  Defined results: a null or empty text gives no ids and decodes to an empty text; repeated rows and null ids are
kept; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_batches, text_or_empty

SPACE = "▁"
#: Bounds of a worker's memory: parts that are kept, and characters of one.
MAX_WORDS, MAX_WORD_CHARS = 600_000, 48
#: Characters that the window takes in at a time, beside the longest piece.
KEPT_CHARS = 32
#: Characters of a text that are cut into parts at a time (more where no blank follows).
SLICE_CHARS = 1 << 16
_CUT = re.compile(f"[^ {SPACE}][ {SPACE}]")
#: Blanks (as their sign) and what follows up to the next one; or blanks at the end.
_PART = re.compile(f"{SPACE}+[^{SPACE}]+|{SPACE}+")
#: The same, cut also where Latin letters and ASCII punctuation meet.
_LETTERS, _MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", r"!-/:-@\[-`{-~"
_FINE_PART = re.compile(rf"{SPACE}*[{_LETTERS}]+(?![^{SPACE}{_MARKS}])|{SPACE}*[{_MARKS}]+(?![^{SPACE}{_LETTERS}])|{SPACE}*[^{SPACE}]+|{SPACE}+")
#: What an uncovered character loses against the least score.
UNKNOWN_PENALTY = 10.0


class Viterbi:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.pieces = {model.id_to_piece(i): (i, model.get_score(i)) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
        self.unknown = model.unk_id()
        self.longest = max(map(len, self.pieces))
        self.uncovered = min(score for _, score in self.pieces.values()) - UNKNOWN_PENALTY
        self.spelt = {i: p for p, (i, _) in self.pieces.items()}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        #: Tree of the pieces: character -> (score or None, id, tree of what may follow).
        self.tree: dict[str, tuple] = {}
        inner: dict[str, dict] = {"": self.tree}
        for p in sorted({p[:k] for p in self.pieces for k in range(1, len(p) + 1)}):
            inner[p] = {}
            i, score = self.pieces.get(p, (0, None))
            inner[p[:-1]][p[-1]] = (score, i, inner[p])
        #: A blank that only starts pieces (or stands among blanks) is a boundary of every path.
        self.blank_starts = not any(SPACE in p.lstrip(SPACE) for p in self.pieces)
        #: Where no piece joins letters and punctuation, paths also meet between these.
        joins = re.compile(rf"[{_MARKS}][{_LETTERS}]|[{_LETTERS}][{_MARKS}]")
        self.parts = _PART if any(map(joins.search, self.pieces)) else _FINE_PART
        self.known: dict[str, tuple[bytes, str]] = {}

    def stream(self, chars: str | Iterable[str]) -> Iterator[list[int]]:
        """Ids of a normalised text, committed as soon as all surviving paths share a boundary."""
        longest, none, uncovered, pieces, tree, odd = self.longest, float("-inf"), self.uncovered, self.pieces, self.tree, False
        source = iter(chars)
        window = "".join(islice(source, longest + KEPT_CHARS))  # never ends before the longest piece from ``start`` does
        more = len(window) == longest + KEPT_CHARS
        # of each boundary in the window: best score, boundary before, id of the last piece (or a character that no piece covers)
        score, before, last = [none] * (len(window) + 1), [0] * (len(window) + 1), [0] * (len(window) + 1)
        score[0] = 0.0
        committed = start = far = 0  # far: the last boundary that a path has reached
        while start < len(window):
            so_far, kids, end = score[start], tree, start
            for c in window[start : start + longest]:
                if c not in kids:
                    break
                end += 1
                gain, i, kids = kids[c]
                if gain is not None:
                    gain += so_far
                    if gain > score[end]:
                        score[end], before[end], last[end] = gain, start, i
                        if end > far:
                            far = end
            start += 1
            if window[start - 1] not in pieces and so_far + uncovered > score[start]:
                score[start], before[start], last[start], odd = so_far + uncovered, start - 1, window[start - 1], True
                if start > far:
                    far = start
            # no path leads over ``start``, or (looked for once a longest piece lies uncommitted) the paths that do have met before it
            shared = start if far == start else self._converged(score, before, start, far) if start - committed >= longest else committed
            if shared > committed:
                out, at = [], shared
                while at > committed:
                    out.append(last[at])
                    at = before[at]
                out.reverse()
                if odd:
                    out, odd = [x for i in out for x in (self._bytes_of(i) if isinstance(i, str) else (i,))], shared < start
                yield out
                committed = shared
            if more and start + longest > len(window):
                lost = score[committed]
                window, start, far = window[committed:] + "".join(islice(source, KEPT_CHARS)), start - committed, far - committed
                more = len(window) >= start + longest
                score = [x - lost for x in score[committed:]]
                before, last = [max(0, x - committed) for x in before[committed:]], last[committed:]
                new, committed = len(window) + 1 - len(score), 0
                score, before, last = score + [none] * new, before + [0] * new, last + [0] * new

    def _bytes_of(self, c: str) -> list[int]:
        return [self.bytes[b] for b in c.encode()] if self.bytes else [self.unknown]

    @staticmethod
    def _converged(score: list[float], before: list[int], start: int, far: int) -> int:
        """The last boundary that the paths to all boundaries from ``start`` on have in common."""
        meet = {b for b in range(start, far + 1) if score[b] != float("-inf")}
        while len(meet) > 1:
            top = max(meet)
            meet.discard(top)
            meet.add(before[top])
        return meet.pop()

    def coded(self, text: str) -> Iterator[tuple[bytes, str]]:
        """Ids of a text as little-endian unsigned 32-bit integers, and what they spell, some at a time."""
        at, sign = 0, SPACE  # the blank that is put before a text
        while at < len(text):
            cut = _CUT.search(text, at + SLICE_CHARS) if self.blank_starts and len(text) - at > SLICE_CHARS else None
            end = cut.start() + 1 if cut else len(text)
            chars, at = sign + text[at:end].replace(" ", SPACE), end
            if self.blank_starts:
                yield self._joined(self.parts.findall(chars))
            else:
                for ids in self.stream(chars):
                    yield np.array(ids, "<u4").tobytes(), self.spelt_out(ids)
            sign = ""

    def _joined(self, parts: list[str]) -> tuple[bytes, str]:
        known = self.known
        found = [known.get(part) or self._part(part) for part in parts]
        return b"".join([raw for raw, _ in found]), "".join([spelt for _, spelt in found])

    def encode(self, text: str) -> bytes:
        return b"".join(raw for raw, _ in self.coded(text))

    def _part(self, part: str) -> tuple[bytes, str]:
        """What the search commits between two boundaries at which it starts anew, and what these ids spell."""
        ids = array("I", chain.from_iterable(self.stream(part)))
        found = ids.tobytes(), self.spelt_out(ids)
        if len(part) <= MAX_WORD_CHARS:
            if len(self.known) >= MAX_WORDS:
                self.known.clear()
            self.known[part] = found
        return found

    def spelt_out(self, ids: Iterable[int]) -> str:
        """Pieces, runs of byte pieces as UTF-8, and blanks for their sign."""
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw = bytearray()
            out.append(self.spelt.get(i, ""))
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out).replace(SPACE, " ")

    def decode(self, ids: np.ndarray) -> str:
        """The text, without the blank that was put before it."""
        return self.spelt_out(ids.tolist()).removeprefix(" ")


@lru_cache(maxsize=2)
def segmenter(path: str) -> Viterbi:
    return Viterbi(path)


def encode_and_decode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian unsigned 32-bit), n_bytes, and whether decoding the ids gives the text back."""
    schema = "doc_id long, n_ids long, ids_crc32 long, n_bytes long, round_trip boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = segmenter(model_path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                n, crc, at, same, plain = 0, 0, -1, True, text.replace(SPACE, " ")  # the first piece begins with a blank of its own
                for raw, part in model.coded(text):
                    n, crc = n + len(raw) // 4, zlib.crc32(raw, crc)
                    same = same and (part[0] == " " and plain.startswith(part[1:]) if at < 0 else plain.startswith(part, at))
                    at += len(part)
                rows.append((doc_id, n, crc, len(text.encode()), same and max(at, 0) == len(plain)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [f.split()[0] for f in schema.split(", ")])

    return map_batches(docs.select(F.col("doc_id").cast("long"), text_or_empty("text").alias("text")), run, schema)
