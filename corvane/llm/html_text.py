"""Main text of web pages from the standard library's parser events.

The parser's events make lines: one for each block of the page, with its characters of text and its
tags. Characters of links do not count as text, nor do those of elements that are no article by their name, role or class.
The text-to-tag ratio of the lines is smoothed with a Gaussian within their container. Lines that have
some text of their own are also carried by others: by the best of the
same container or article; by near lines of other containers, more weakly with every line between and only from both sides, so that a short block between long ones is
content and one beside them is not; and a heading by what it stands above. A threshold from the
spread of the smoothed ratios parts the lines into regions of content and the rest.

No name settles a line alone: an element that holds most of the page's text counts whatever it is called, and
lines outside of an article weigh less only while the article has more text than they.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import only, text_of

# HTML's element names by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CONTAINERS = frozenset(
    "article aside body center details dialog dir div dl fieldset footer form head header html main menu nav ol section table td th ul".split()
)
BLOCK = CONTAINERS | frozenset(
    "address blockquote caption dd dt figcaption figure h1 h2 h3 h4 h5 h6 hr legend li option p pre summary "
    "tbody tfoot thead title tr".split()
)
SPACED = frozenset("br img input".split())
UNREAD = frozenset(
    "audio button canvas datalist embed head iframe map math noscript object script select style svg template "
    "textarea title video".split()
)
APART = frozenset("aside dialog footer form menu nav".split())
ARTICLE = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense alert banner breadcrumb breadcrumbs comment "
    "comments commentlist consent cookie cookies disqus footer gdpr login masthead menu menus modal nav navbar "
    "navigation newsletter notice notices notification pagination popup promo promoted promotion reader-comments "
    "related respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar "
    "topbar widget widgets".split()
)
CLOSED_BY = {"p": BLOCK, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"])}

#: Standard deviation of the Gaussian, in lines; that of the one by which lines of other containers carry; and of the lines' ratios, the part that content reaches.
SIGMA, SPAN = 1.0, 8.0
THRESHOLD = 0.5
#: Part of its best line's ratio with which a container or an article carries each of its lines: no spread of the ratios sets a higher threshold.
CARRIED = 0.25
#: Least weight of a region beside an article.
BESIDE = 1 / 4
#: Characters a tag, smoothed, that are enough in an article, so that its short parts stay beside its long ones.
ENOUGH = 4.0
#: Parts of the page's text from which on an element is not apart from it: by its class or role, by its tag.
MOST, NEARLY_ALL = 0.5, 0.9
_WORDS = re.compile(r"[^0-9a-z]+")


def is_apart(tag: str, attrs: list[tuple[str, str | None]], inside: bool) -> bool:
    """Whether an element says that it is no part of the article. inside: within an article, whose own header belongs to it."""
    if tag in APART or (tag == "header" and not inside):
        return True
    if tag in ARTICLE or tag in ("html", "body"):
        return False
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if not value:
            continue
        if name in ("class", "id"):
            low = value.lower()
            if not MARKS.isdisjoint(low.split()) or not MARKS.isdisjoint(_WORDS.split(low)):
                return True
        elif name == "role" and value.lower() in ROLES or name == "style" and "display:none" in value.replace(" ", "").lower():
            return True
    return False


class Line(NamedTuple):
    text: str
    chars: int
    tags: int
    region: int
    article: int
    apart: int
    heading: bool


class Open(NamedTuple):
    tag: str
    apart: int
    unread: bool
    article: bool
    link: bool


class Lines(HTMLParser):
    """Collects a page's lines: text, characters outside of links, tags, region, the number of the outermost article
    around it (0: none), the innermost element around it that is named apart, if any, and whether it is a heading.
    ``apart`` has for each of those elements the next one around it and its tag."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.stack: list[Open] = []
        self.blocks: list[int] = []
        self.open: Counter[str] = Counter()
        self.apart: list[tuple[int, str]] = []
        self.unread = self.links = self.articles = self.nth_article = self.headings = self.region = self.tags = self.linked = 0
        self.parts: list[str] = []

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split()) if self.parts else ""
        if text:
            chars = max(0, len(text) - self.linked)
            inner = self.stack[-1].apart if self.stack else -1
            article = self.nth_article if self.articles else 0
            self.lines.append(Line(text, chars, max(1, self.tags), self.region, article, inner, self.headings > 0))
            self.tags = 0
        self.parts.clear()
        self.linked = 0

    def pop_to(self, at: int) -> None:
        for one in self.stack[at:]:
            self.open[one.tag] -= 1
            self.unread -= one.unread
            self.articles -= one.article
            self.headings -= one.tag in HEADINGS
            self.links -= one.link
        del self.stack[at:]
        while self.blocks and self.blocks[-1] >= at:
            self.blocks.pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.flush()
            while self.blocks:
                at = self.blocks[-1]
                name = self.stack[at].tag
                if name == "head" or tag in CLOSED_BY.get(name, ()):
                    self.pop_to(at)
                else:
                    break
        elif tag in SPACED:
            self.parts.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        apart = self.stack[-1].apart if self.stack else -1
        if is_apart(tag, attrs, self.articles > 0):
            self.flush()
            self.apart.append((apart, tag))
            apart = len(self.apart) - 1
        if tag in CONTAINERS:
            self.region += 1
        one = Open(tag, apart, tag in UNREAD, tag in ARTICLE, tag == "a")
        self.unread += one.unread
        self.nth_article += one.article and not self.articles
        self.articles += one.article
        self.headings += tag in HEADINGS
        self.links += one.link
        self.open[tag] += 1
        if tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(one)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        self.tags += 1
        if not self.open[tag]:
            return
        at = len(self.stack) - 1
        while self.stack[at].tag != tag:
            at -= 1
        if self.stack[at].apart != (self.stack[at - 1].apart if at else -1):
            self.flush()
        self.pop_to(at)
        if tag in CONTAINERS:
            self.region += 1

    def handle_data(self, data: str) -> None:
        if not self.unread:
            self.parts.append(data)
            if self.links:
                self.linked += len(" ".join(data.split()))


def by_gauss(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """The ratios under a Gaussian of this standard deviation, cut at two of them; ends weigh what they have."""
    reach = max(1, round(2 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    total = np.convolve(ratios, kernel)[reach : reach + len(ratios)]
    return total / np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]


def smoothed(ratios: np.ndarray, bounds: list[int], groups: np.ndarray, share: np.ndarray, heading: np.ndarray) -> np.ndarray:
    """Each container's ratios, between two ``bounds``, under the Gaussian; or what a line is carried with, times the ``share`` of its text that counts."""
    own = np.concatenate([by_gauss(ratios[a:b], SIGMA) for a, b in zip(bounds, bounds[1:], strict=False)])
    n, (before, after) = len(own), np.zeros((2, len(own)))
    for d in range(1, min(n, round(3 * SPAN) + 1)):
        weaker = float(np.exp(-0.5 * (d / SPAN) ** 2))
        np.maximum(before[d:], own[:-d] * weaker, out=before[d:])
        np.maximum(after[:-d], own[d:] * weaker, out=after[:-d])
    of = np.unique(groups, return_inverse=True)[1]
    best = np.zeros(n)
    np.maximum.at(best, of, own)
    within = CARRIED * best[of]
    value = np.maximum(own, share * np.maximum(within, np.minimum(before, after)))
    for i in np.nonzero(heading[:-1])[0][::-1].tolist():
        value[i] = max(value[i], share[i] * value[i + 1])
    return value


def names_that_hold(page: Lines) -> np.ndarray:
    """For each element that is named apart, whether it is: not if it holds most of the text, and the article's if there is one."""
    whole, articles = np.zeros(len(page.apart) + 1, dtype=np.int64), np.zeros(len(page.apart) + 1, dtype=np.int64)
    for line in page.lines:
        whole[line.apart] += len(line.text)
        articles[line.apart] += len(line.text) if line.article else 0
    for i in range(len(page.apart) - 1, -1, -1):  # elements come after those around them
        whole[page.apart[i][0]] += whole[i]
        articles[page.apart[i][0]] += articles[i]
    part = np.array([NEARLY_ALL if tag in APART or tag == "header" else MOST for _, tag in page.apart])
    if articles[-1]:
        large = articles[:-1] > MOST * articles[-1]
    else:
        large = (whole[:-1] > part * whole[-1]) & (not page.nth_article)
    return ~large


def ratios(chars: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Characters of text a tag."""
    return chars / tags


def content(page: Lines) -> list[str]:
    """The lines of the regions that count as content."""
    lines = page.lines
    holds, named = names_that_hold(page), np.zeros(len(page.apart) + 1, dtype=bool)
    for i, (around, _) in enumerate(page.apart):
        named[i] = holds[i] or (around >= 0 and named[around])
    apart = named[[x.apart for x in lines]]
    article = np.where(apart, 0, [x.article for x in lines])
    chars = np.where(apart, 0.0, [x.chars for x in lines])
    # a container's lines go on as long as neither it nor what is said of it changes
    labels = [(x.region, a) for x, a in zip(lines, apart.tolist(), strict=True)]
    bounds = [0, *(i for i in range(1, len(lines)) if labels[i] != labels[i - 1]), len(lines)]
    ratio = ratios(chars, np.array([x.tags for x in lines]))
    if article.any():
        of_region = np.add.reduceat(chars, bounds[:-1]) / max(1.0, chars[article > 0].sum())
        ratio = ratio * np.where(article > 0, 1.0, np.repeat(np.clip(of_region, BESIDE, 1.0), np.diff(bounds)))
    groups = np.where(article > 0, -article, [x.region for x in lines])
    share = chars / np.array([len(x.text) for x in lines])
    value = smoothed(ratio, bounds, groups, share, np.array([x.heading for x in lines]))
    limit = THRESHOLD * value.std()
    enough = np.where(article > 0, min(limit, ENOUGH), limit)
    return [x.text for x, taken in zip(lines, value >= enough, strict=True) if taken] if value.max() > 0 else []


def whole_tags(html: str) -> str:
    """The page, in which every tag and comment that is begun has an end, so that the parser looks through each once.

    A sign ``<`` that no ``>`` follows is text; a comment that is not closed goes on to the end.
    """
    at = html.rfind(">") + 1
    html = html[:at] + html[at:].replace("<", "&lt;")
    return html + "<!---->" if html.rfind("<!--") > html.rfind("-->") else html


def main_text(html: str) -> str:
    """The blocks of the page's content regions, joined by blank lines; empty if there is no text."""
    page = Lines()
    page.feed(whole_tags(html))
    page.close()
    page.flush()
    return "\n\n".join(content(page)) if page.lines else ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py()) for h in batch.column(2)]
        columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a page: page_id, url, text (the article, empty if none), n_chars (its code points).

    A null or empty page gives an empty text; null ids and urls are kept, repeated rows are repeated,
    and other columns are ignored. Broken markup is read as browsers do: a block closes an open
    paragraph, and what is open at the end is closed there.
    """
    named = only(pages, page_id=F.col(id_col).cast("long"), url=F.col(url_col), html=text_of(html_col))
    return named.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
