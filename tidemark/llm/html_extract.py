"""Main text of web pages: standard-library parser events, text-to-tag ratios, Gaussian smoothing, clustering by threshold."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table, text_of

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose text is never content.
SKIP = frozenset("aside audio button canvas datalist dialog embed footer form head iframe input math menu nav noscript object option script select style svg template textarea title video".split())
#: Elements that don't gather lines of their own: a line belongs to the nearest other element around it.
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre summary caption figcaption".split())
#: Those that end where another of the same kind begins.
IMPLIED = frozenset("p li dt dd".split())
#: Words of a class, id or role that mark what is seldom content: such a line's ratio counts for little.
MARKS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments commentlist complementary consent contentinfo cookie cookies dialog disqus footer header masthead menu menubar modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar widget".split())
WORDS = re.compile(r"[a-z]+")
#: Standard deviation of the smoothing in lines; share of the ratios' standard deviation that content exceeds, and the ratio that is enough.
SIGMA, CUT, ENOUGH = 2.0, 0.02, 1.0
#: Share of the largest gathering's text that another one must have; weight of marked lines.
GATHERED, MARKED = 0.25, 0.005


class Line(NamedTuple):
    text: str
    tags: int  # that stand before it and in it, since the line before
    linked: int  # characters of it in links
    marked: bool
    gathering: int  # the element that it belongs to


class Lines(HTMLParser):
    """Collects a page's lines: runs of text between block-level tags that aren't skipped."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool, bool]] = []  # tag, number of its gathering or 0, whether skipped, whether marked
        self.lines: list[Line] = []
        self.counts: Counter[str] = Counter()  # of open elements by tag
        self.gatherings = [0]
        self.numbers = self.skipped = self.marked = self.links = self.tags = self.linked = 0
        self.text: list[str] = []
        self.endless: set[str] = set()  # kinds of markup whose ends don't come any more

    def flush(self) -> None:
        words = "".join(self.text).split()
        if words:
            self.lines.append(Line(" ".join(words), self.tags, self.linked, self.marked > 0, self.gatherings[-1]))
            self.tags = 0
        self.text, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in INLINE:
            self.flush()
        self.tags += 1
        self.links += tag == "a"
        if tag in VOID:
            return
        if tag in IMPLIED:
            self.close_implied(tag)
        skip = tag in SKIP or (tag == "header" and not self.counts["article"]) or self.hidden(attrs)
        mark = tag not in ("html", "body", "article", "main") and self.named(attrs)
        if tag in INLINE and not skip and not mark:
            return
        if tag not in INLINE and tag not in FLOW:
            self.numbers += 1
        self.push(tag, 0 if tag in INLINE or tag in FLOW else self.numbers, skip, mark)

    def push(self, tag: str, number: int, skip: bool, mark: bool) -> None:
        self.open.append((tag, number, skip, mark))
        self.skipped += skip
        self.marked += mark
        self.counts[tag] += 1
        if number:
            self.gatherings.append(number)

    def close(self) -> None:
        super().close()
        self.flush()

    def parse_comment(self, i: int, report: bool = True) -> int:
        """As it was, but once no end of a comment is left it isn't looked for again."""
        at = -1 if "comment" in self.endless else super().parse_comment(i, report)
        if at < 0:
            self.endless.add("comment")
        return at

    def parse_marked_section(self, i: int, report: bool = True) -> int:
        """A marked section of a kind that there isn't, or without an end, is a comment up to the next ``>``."""
        kind = self.rawdata[i + 3 : i + 5].lower()
        at = -1
        if kind not in self.endless:
            try:
                at = super().parse_marked_section(i, report)
            except AssertionError:
                pass
        if at < 0:
            self.endless.add(kind)
            at = self.parse_bogus_comment(i)
        return at

    def close_to(self, at: int) -> None:
        for tag, number, skip, mark in self.open[at:]:
            self.skipped -= skip
            self.marked -= mark
            self.counts[tag] -= 1
            if number:
                self.gatherings.pop()
        del self.open[at:]

    def close_implied(self, tag: str) -> None:
        """A paragraph or item ends where another begins, unless an element that gathers lines stands between them."""
        if self.counts[tag]:
            for at in range(len(self.open) - 1, -1, -1):
                if self.open[at][0] == tag:
                    return self.close_to(at)
                if self.open[at][1]:
                    return None
        return None

    @staticmethod
    def hidden(attrs: list) -> bool:
        return any(name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and value and "display:none" in value.replace(" ", "").lower()) for name, value in attrs)

    @staticmethod
    def named(attrs: list) -> bool:
        return any(name in ("class", "id", "role") and value and not MARKS.isdisjoint(WORDS.findall(value.lower())) for name, value in attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        self.tags += 1
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag in IMPLIED:
            return self.close_implied(tag)
        if self.counts[tag]:
            for at in range(len(self.open) - 1, -1, -1):
                if self.open[at][0] == tag:
                    return self.close_to(at)
        return None

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            self.text.append(data)
            self.linked += len(data) * (self.links > 0)


def smoothed(ratio: np.ndarray, weak: np.ndarray) -> np.ndarray:
    """Means of the neighbours, weighted by a Gaussian; for ``weak`` ones the lesser of those to either side."""
    reach = np.arange(-int(3 * SIGMA), int(3 * SIGMA) + 1)
    kernel, half = np.exp(-(reach**2) / (2 * SIGMA**2)), len(reach) // 2

    def mean(weights: np.ndarray) -> np.ndarray:
        total = np.convolve(np.ones(len(ratio)), weights)[half:][: len(ratio)]
        return np.convolve(ratio, weights)[half:][: len(ratio)] / np.maximum(total, 1e-300)

    return np.where(weak, np.minimum(mean(kernel * (reach < 0)), mean(kernel * (reach > 0))), mean(kernel))


def content_lines(lines: list[Line]) -> np.ndarray:
    """Whether each line is in the cluster of content.

    A line's ratio is its text that isn't in links, to its tags; that of a
    marked line counts for little. Smoothing is along the lines of a gathering,
    so neighbours lift a short line among long ones, but not an advert beside
    them; a marked or linked line must be lifted from both sides. What exceeds a share of the ratios' standard deviation, or has enough
    text a tag in any case, is content.
    """
    ratio = np.array([(len(x.text) - x.linked) * (MARKED if x.marked else 1) / max(1, x.tags) for x in lines])
    weak, group = np.array([x.marked or 2 * x.linked > len(x.text) for x in lines]), np.array([x.gathering for x in lines])
    smooth = np.zeros(len(lines))
    for g in np.unique(group):
        smooth[group == g] = smoothed(ratio[group == g], weak[group == g])
    return smooth >= max(min(CUT * ratio.std(), ENOUGH), 1e-9)


def select(lines: list[Line]) -> list[str]:
    """The content lines of the elements that gather a fair share of the content."""
    if not lines:
        return []
    content, mass = content_lines(lines), {}
    for x, inside in zip(lines, content, strict=True):
        mass[x.gathering] = mass.get(x.gathering, 0) + len(x.text) * bool(inside)
    least = GATHERED * max(mass.values())
    return [x.text for x, inside in zip(lines, content, strict=True) if inside and mass[x.gathering] >= least]


def main_text(html: str) -> str:
    parser, end = Lines(), html.rfind(">") + 1
    parser.feed(html[:end])
    parser.goahead(True)
    # No markup ends after the last ``>``, so what follows is text.
    parser.handle_data(unescape(html[end:]))
    parser.close()
    return "\n".join(select(parser.lines))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text``, one row per input row.

    Menus, headers and footers of the page, sidebars, notices, adverts, forms,
    scripts, styles, markup and comments go; references are decoded; white
    space within a block is one space; blocks are joined by line feeds in page
    order. A null or empty page, and one without content, has the empty text.
    Pages may repeat, and be broken or very long: each is parsed whole, in one
    pass. Null ids and addresses are kept; other columns are ignored.
    """
    id_type, url_type = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = pa.array([main_text(h.as_py()) for h in part.column(2)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), texts], ["page_id", "url", "text"])

    chosen = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text_of(html_col).alias("h"))
    return chosen.mapInArrow(run, f"page_id {id_type}, url {url_type}, text string")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
