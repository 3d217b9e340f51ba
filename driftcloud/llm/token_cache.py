"""Token ids by the tokenizers library, which is called only for parts of words that a worker has not met lately.

Neither tokenizer used here merges across the borders below, so a text's ids are its words' ids one after another.
The words of a whole batch of texts are made distinct first (Arrow's dictionary encoding), then what stands before and
in their closing punctuation; new parts go to the library, odd ones many at a time, with a separator between them whose
id is known.  Texts with rarer white space or with what may be a special token's literal go to the library whole.
"""

from __future__ import annotations

import os
from array import array
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Spark already keeps every core busy.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: White space other than blank and line end, as patterns of tokenizers or Python may see it.
_RARE_SPACE = r"[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Texts that hold any of these are encoded whole: by kind of tokenizer (keeps space, drops space).
_WHOLE = {False: rf"<\||{_RARE_SPACE}|[ \n][ \n]|^[ \n]|[ \n]$", True: rf"<\||\x01|{_RARE_SPACE}"}
#: Letters up to here (Latin, Greek, Cyrillic) are the same in all tables of characters; words with others go to the library.
_LETTERS_BELOW = 0x530
#: Lower case of these depends on their place or changes their number.
_ODD_CASE = "\u03a3\u0130"
#: ASCII punctuation: a run of it at a word's end is a part of its own if only letters stand before it.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_TAIL = r"(?P<marks>[!-/:-@\[-`{-~]*)\z"
#: Bounds of a worker's memory: parts in each of two generations, and characters of a part that is kept.
MAX_PARTS, MAX_PART_CHARS = 400_000, 48
#: Texts whose words are made distinct together.
TOKEN_BATCH = 4096
#: New odd words that the library gets as one text.
JOINED = 500


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


def _simple(drops_space: bool) -> str:
    """Pattern of a blank and letters that the model's merges may have as they are.  Numbers such as \u00b2 are no letters."""
    letters = (c for c in map(chr, range(_LETTERS_BELOW)) if c.isalpha())
    return "\\A ?[" + "".join(c for c in letters if not drops_space or c not in _ODD_CASE and is_normalized("NFC", c)) + "]+\\z"


def _gather(store: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slices of ``store`` one after another, and where each ends."""
    ends = np.cumsum(sizes)
    return store[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)], ends


class BatchEncoder:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.drops_space = "Removed" in repr(self.tokenizer.pre_tokenizer)
        self.separator = " \x01 " if self.drops_space else "\n"
        (self.separator_id,) = self.tokenizer.encode(self.separator, add_special_tokens=False).ids
        self.merge = self.tokenizer.model.tokenize
        self.simple = _simple(self.drops_space)
        self.newer: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (strings, no nulls) one after another, and the bounds of each text's ids."""
        whole = pc.match_substring_regex(texts, _WHOLE[self.drops_space]).to_numpy(zero_copy_only=False)
        ids, bounds = self._by_words(texts.filter(pa.array(~whole)))
        if not whole.any():
            return ids, bounds
        long = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts.filter(pa.array(whole)).to_pylist(), add_special_tokens=False)]
        short = iter(np.split(ids, bounds[1:-1]) if len(bounds) > 1 else [])
        rest = iter(long)
        parts = [next(rest) if w else next(short) for w in whole]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _by_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        if self.drops_space:
            lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        else:  # a word keeps the line end before it; any other has a blank before it
            lists = pc.split_pattern(pc.binary_join_element_wise("\n", pc.replace_substring(texts, "\n", " \n"), ""), " ")
        words = lists.flatten().dictionary_encode()
        store, starts, sizes = self._of_words(words.dictionary)
        index = words.indices.to_numpy()
        ids, ends = _gather(store, starts[index], sizes[index])
        at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        bounds = np.concatenate([[0], ends])[at]
        if self.drops_space:
            return ids, bounds
        keep = np.ones(len(ids), bool)
        keep[bounds[:-1]] = False  # the line end put before the text
        return ids[keep], bounds - np.arange(len(bounds))

    def _of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words, where each word's start, and how many they are."""
        opens = np.zeros(len(words), bool)
        if not self.drops_space:  # a word that opens a line has no blank before it
            opening = pc.starts_with(words, "\n")
            opens = opening.to_numpy(zero_copy_only=False)
            bare = pc.utf8_ltrim(words, "\n")
            words = pc.if_else(opening, bare, pc.binary_join_element_wise(" ", bare, ""))
        before = pc.utf8_rtrim(words, _MARKS)
        simple = pc.match_substring_regex(before, self.simple)
        marks = pc.struct_field(pc.extract_regex(words, _TAIL), "marks")
        columns = [pc.if_else(simple, before, words), pc.if_else(simple, marks, "")]
        stores, starts, sizes, at = [np.array([self.separator_id], "<u4")], [np.zeros(len(words), np.int64)], [opens.astype(np.int64)], 1
        for column in columns:
            distinct = column.dictionary_encode()
            found = self._known(distinct.dictionary)
            n, index = np.fromiter(map(len, found), np.int64, len(found)) // 4, distinct.indices.to_numpy()
            stores.append(np.frombuffer(b"".join(found), "<u4"))
            starts.append((np.cumsum(n) - n + at)[index])
            sizes.append(n[index])
            at += len(stores[-1])
        store, ends = _gather(np.concatenate(stores), np.stack(starts, axis=1).ravel(), np.stack(sizes, axis=1).ravel())
        n = np.sum(sizes, axis=0)
        return store, ends[len(sizes) - 1 :: len(sizes)] - n, n

    def _known(self, parts: pa.Array) -> list[bytes]:
        """Ids of distinct parts: letters go to the model's merges, so does punctuation; anything odd is encoded with separators between."""
        spelt = parts.to_numpy(zero_copy_only=False).tolist()  # several times as fast as to_pylist()
        found = list(map(self.newer.get, spelt))
        new = [i for i, ids in enumerate(found) if ids is None]
        if not new:
            return found
        mergeable = pc.match_substring_regex(parts, rf"{self.simple}|\A[!-/:-@\[-`{{-~]+\z").to_numpy(zero_copy_only=False)
        odd, older = [], self.older.get
        for i in new:
            ids = older(spelt[i])
            if ids is None:
                if not spelt[i]:
                    ids = b""
                elif mergeable[i]:
                    ids = self._merged(spelt[i])
                else:
                    odd.append(i)
                    continue
            found[i] = ids
        for k in range(0, len(odd), JOINED):
            block = odd[k : k + JOINED]
            ids = np.array(self.tokenizer.encode(self.separator.join(spelt[i] for i in block), add_special_tokens=False).ids, "<u4")
            cuts, raw, a = np.flatnonzero(ids == self.separator_id), ids.tobytes(), 0
            if len(cuts) != len(block) - 1:
                raise AssertionError("a separator was merged with a word")
            for i, b in zip(block, [*(cuts * 4).tolist(), len(raw)]):
                found[i] = raw[a:b]
                a = b + 4
        if len(self.newer) + len(new) > MAX_PARTS:
            self.newer, self.older = {}, self.newer
        self.newer.update((spelt[i], found[i]) for i in new[:MAX_PARTS] if len(spelt[i]) <= MAX_PART_CHARS)
        return found

    def _merged(self, text: str) -> bytes:
        """Ids of what the tokenizer's pattern keeps whole."""
        if self.drops_space:
            text = text.lower()
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(_LETTERS)
        elif text[0] == " ":
            text = _LETTERS[32] + text[1:]
        return array("I", [t.id for t in self.merge(text)]).tobytes()


@lru_cache(maxsize=4)
def encoder(path: str) -> BatchEncoder:
    """One encoder a worker process, kept between tasks."""
    return BatchEncoder(path)
