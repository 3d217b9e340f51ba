"""Operator 4: main text of a page by text-to-tag ratio.

Standard-library parser events, fed piece by piece, make lines (one per block element).  Each line has a ratio of text
to tags; the ratios are smoothed with a Gaussian kernel, and lines at or above a share of their standard deviation seed
content regions.  A region is the article or main element around a seed; where more of the seeds' text lies outside of
these, it is the block around a seed (paragraphs, headings, lists and tables are no such blocks) and all between the first
and the last of these seeds.  A region's other lines belong to it.  Elements that are never content by their name or role
(menus, headers, footers, notices, forms, scripts, styles) take no part.  A class or id (sidebar, advert, comments) drops an
element too if all words of the name speak of such a part (``share-buttons``, not ``share-price``), but not an article or main, and
not one that turns out to wrap the content (``wrappers``).  A block that is mostly links is dropped where none of its lines
reaches the threshold, also inside a region (``menus``).

Defined results: a null or empty html, or one without content, gives an empty text and 0 characters; unclosed or stray
tags are repaired as browsers do; repeated rows and null ids are kept; very long pages are fed in portions; no pages give no rows;
extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_batches, text_or_empty

FEED_CHARS, SIGMA, THRESHOLD = 1 << 20, 1.0, 0.5

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
NEVER = frozenset("aside button canvas dialog fieldset footer frameset head iframe input label map menu nav noscript object script search select style svg template textarea title".split())
REGIONS = frozenset(("article", "main"))
#: Blocks of a text's own; their lines belong to the block around them.
PARTS = frozenset("address blockquote dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr li ol p pre summary table tbody td tfoot th thead tr ul".split())
#: A new block ends an open paragraph; these end an open one of their own kind.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NEVER_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search status toolbar".split())
#: Words that only say which part of the page the other words of a class name mean.
PART_WORDS = frozenset("area bar block body bottom box center container content desktop first footer foot form group head header holder inner info item items last left link links list main message mobile module note notes outer panel post right row section slot text top unit wrap wrapper zone".split())
NEVER_WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent buttons button cookie cookies discussion discussions disqus gdpr menu modal nav navbar navigation newsletter notice notices overlay popup promo promoted promotion related replies reply respond share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget widgets".split())
#: Anywhere in a class or id: what readers wrote (commentaries and commentators are of the page's own).
_COMMENTS = re.compile(r"comment(?!ar|at)|disqus")
#: Only outside an article: inside, they name its own parts.
OUTER_WORDS = frozenset("footer foot header masthead copyright topbar".split())


@dataclass
class Line:
    text: str
    tags: int
    region: int  # number of the article or main around it, 0 for none
    parent: int  # number of the block around it
    out: bool
    linked: int = 0  # characters inside links
    doubtful: tuple[int, ...] = ()  # numbers of the elements around it whose class or id speaks against them, outermost first


class LineParser(HTMLParser):
    """Turns parser events into lines."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[tuple[str, bool, int, int, tuple[int, ...]]] = []  # name, out, region, number, doubtful
        self.around: dict[int, tuple[int, ...]] = {}  # doubtful elements around each region
        self.titled: tuple[int, ...] | None = None  # and around the first h1
        self.parts: list[str] = []
        self.tags = self.numbers = self.linked = 0

    def _state(self) -> tuple[bool, int, int, tuple[int, ...]]:
        return self.open[-1][1:] if self.open else (False, 0, 0, ())

    def _end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            out, region, parent, doubtful = self._state()
            self.lines.append(Line(text, max(1, self.tags), region, parent, out, min(self.linked, len(text)), doubtful))
            self.tags = 0
        self.linked = 0
        self.parts.clear()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        block = tag in BLOCKS or tag in NEVER
        if block:
            self._end_line()
            self._close({"p"}, stop=BLOCKS - {"p"}) if tag in BLOCKS else None
            if tag in SIBLINGS:
                self._close(SIBLINGS[tag], stop={"ul", "ol", "dl", "table", "select", "menu"})
        if tag in VOID:
            return
        out, region, parent, doubtful = self._state()
        out = out or self._never(tag, attrs, region)
        self.numbers += 1
        if self._doubted(tag, attrs, region):
            doubtful = (*doubtful, self.numbers)
        if block and tag not in PARTS:
            parent = self.numbers
        if tag in REGIONS:
            region = self.numbers
            self.around[region] = doubtful
        if tag == "h1" and self.titled is None and not out:
            self.titled = doubtful
        self.open.append((tag, out, region, parent, doubtful))

    def _never(self, tag: str, attrs: list[tuple[str, str | None]], region: int) -> bool:
        if tag in NEVER or tag == "header" and not region:
            return True
        if tag in ("html", "body"):
            return False
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and (value or "").lower() in NEVER_ROLES:
                return True
            if name == "style" and re.search(r"display\s*:\s*none", value or ""):
                return True
        return False

    def _doubted(self, tag: str, attrs: list[tuple[str, str | None]], region: int) -> bool:
        if tag in ("html", "body"):
            return False
        if tag == "form" or ("role", "form") in attrs:  # one that holds the text stays, as any wrapper does
            return True
        for name, value in attrs:
            if name in ("class", "id"):
                if _COMMENTS.search((value or "").lower()):
                    return True
                if tag in REGIONS:
                    continue
                against = NEVER_WORDS if region else NEVER_WORDS | OUTER_WORDS
                for token in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value or "").lower().split():
                    words = set(re.split(r"[^a-z]+", token)) - {""}
                    if words & against and words <= NEVER_WORDS | OUTER_WORDS | PART_WORDS:  # share-price is no share button
                        return True
        return False

    def _close(self, names: set[str], stop: set[str] | frozenset[str]) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in names:
                del self.open[i:]
                return
            if self.open[i][0] in stop:
                return

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in VOID:
            return
        if tag in BLOCKS or tag in NEVER:
            self._end_line()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break
            if tag not in BLOCKS and self.open[i][0] in BLOCKS:
                break  # an inline end tag doesn't close a block

    def handle_data(self, data: str) -> None:
        if not (self.open and self.open[-1][0] in ("script", "style")):
            self.parts.append(data)
            if any(x[0] == "a" for x in self.open):
                self.linked += len(data.strip())

    def close(self) -> None:
        super().close()
        self._end_line()


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing with a kernel of two sigmas to either side, normalised at the ends."""
    reach = max(1, int(np.ceil(2 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return (np.convolve(ratios, kernel, "full") / np.convolve(np.ones(len(ratios)), kernel, "full"))[reach : reach + len(ratios)]


def wrappers(parser: LineParser, seeds: list[Line]) -> set[int]:
    """Doubtful elements that wrap the content: those around the first h1 with most of the seeds' text; those around a region,
    if no region is free of doubt; and, while no seed is left otherwise, the one with most of the seeds' text."""
    size = sum(len(line.text) for line in seeds)
    held: Counter[int] = Counter()
    for line in seeds:
        for n in line.doubtful:
            held[n] += len(line.text)
    kept = {n for n in parser.titled or () if 2 * held[n] > size}
    if not any(line.region and kept.issuperset(line.doubtful) for line in seeds):
        kept.update(n for line in seeds if line.region for n in parser.around[line.region])
    while seeds and not any(kept.issuperset(line.doubtful) for line in seeds):
        most = max(sorted(set(held) - kept), key=lambda n: held[n])  # of equal ones the outermost
        if 2 * held[most] <= size:
            break
        kept.add(most)
    return kept


def menus(lines: list[Line], low: list[bool]) -> set[int]:
    """Blocks of at least three lines, none of which reached the threshold, that are mostly links."""
    size, linked, count = Counter(), Counter(), Counter()
    for line, is_low in zip(lines, low):
        size[line.parent] += len(line.text)
        linked[line.parent] += line.linked if is_low else -len(line.text)
        count[line.parent] += 1
    return {n for n in size if count[n] >= 3 and 2 * linked[n] > size[n]}


def main_text(html: str, sigma: float = SIGMA, threshold: float = THRESHOLD) -> str:
    parser = LineParser()
    for at in range(0, len(html), FEED_CHARS):
        parser.feed(html[at : at + FEED_CHARS])
    parser.close()
    lines = parser.lines
    if all(line.out for line in lines):
        return ""
    ratios = smoothed(np.array([len(line.text) / line.tags for line in lines]), sigma)
    cut = threshold * ratios.std()
    listed = menus(lines, [ratio < cut for ratio in ratios])
    for line in lines:
        line.out = line.out or line.parent in listed
    if all(line.out for line in lines):
        return ""
    kept = wrappers(parser, [line for line, ratio in zip(lines, ratios) if ratio >= cut and not line.out])
    allowed = [(line, ratio) for line, ratio in zip(lines, ratios) if not line.out and kept.issuperset(line.doubtful)]
    if not allowed:
        return ""
    seeds = [i for i, (_, ratio) in enumerate(allowed) if ratio >= cut] or list(range(len(allowed)))
    allowed = [line for line, _ in allowed]
    loose = [i for i in seeds if not allowed[i].region]
    if 2 * sum(len(allowed[i].text) for i in loose) <= sum(len(allowed[i].text) for i in seeds):
        regions = {allowed[i].region for i in seeds} - {0}
        return " ".join(line.text for line in allowed if line.region in regions)
    # a short line is smeared with the long ones beside it; in a block of its own it needs a ratio of its own
    strong = {allowed[i].parent for i in loose if len(allowed[i].text) / allowed[i].tags >= cut}
    loose = [i for i in loose if allowed[i].parent in strong] or loose
    parents = {allowed[i].parent for i in loose}
    return " ".join(line.text for i, line in enumerate(allowed) if loose[0] <= i <= loose[-1] or line.parent in parents)


def extract_main_text(pages: DataFrame, sigma: float = SIGMA, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, url, text, n_chars."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html.as_py(), sigma, threshold) for html in batch["html"]]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_batches(pages.select(F.col("page_id").cast("long"), "url", text_or_empty("html").alias("html")), extract, "page_id long, url string, text string, n_chars long")
