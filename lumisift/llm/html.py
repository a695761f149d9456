"""Main text of web pages: parser events, text-to-tag ratios, smoothing and clustering."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var wbr".split())
NEVER = frozenset("head title script style noscript template iframe object embed applet canvas svg math audio video map button "
                  "select option textarea input datalist nav menu aside footer dialog frameset noframes".split())
ARTICLE = frozenset(("article", "main"))
REGION = frozenset("article main section div td body".split())
RAW = frozenset(("script", "style"))
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())  # others end an open head
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
# Words in classes and ids that tell what is not the article.
MARKS = frozenset("ad ads adv advert adverts advertisement advertising adbox adslot banner banners breadcrumb breadcrumbs comment comments "
                  "commentlist consent cookie cookies copyright discussion disqus footer gdpr legal login menu menus modal nav navbar "
                  "navigation newsletter notice notices notification overlay pagination pager paywall popup promo promoted promotion "
                  "recommended related reply replies respond share sharing sidebar sidebars signup social sponsor sponsored sponsors "
                  "subscribe toolbar widget widgets".split())
HEADS = frozenset("header masthead topbar".split())  # not the article's, unless inside it
PARAGRAPH, PER_TAG = 200, 20  # characters of a line, and for each tag before it, that make it part of the text wherever it stands
PER_LINK = 8  # characters for each tag that a line of links has less than

_WORD = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def unwanted(tag: str, attributes: dict[str, str | None], in_article: bool) -> bool:
    """Whether an element is no part of the article, by its name, role and style."""
    if tag in NEVER or (tag == "header" and not in_article):
        return True
    if not attributes:
        return False
    role = (attributes.get("role") or "").lower()
    if role in ROLES or "hidden" in attributes or (attributes.get("aria-hidden") or "").lower() == "true":
        return True
    if _HIDDEN.search((attributes.get("style") or "").lower()):
        return True
    return False


def marked(tag: str, attributes: dict[str, str | None], in_article: bool) -> bool:
    """Whether an element is a form, or a class or id of its own says that it is no part of the article.

    A class counts as a whole: `has-sidebar` tells nothing, `ad-banner` is of marks only.
    """
    if tag in ("html", "body") or tag in ARTICLE:
        return False
    if tag == "form":
        return True
    if not attributes:
        return False
    for name in f"{attributes.get('class') or ''} {attributes.get('id') or ''}".lower().split():
        words = _WORD.findall(name)
        if words and all(w in MARKS or (w in HEADS and not in_article) for w in words):
            return True
    return False


class Lines(HTMLParser):
    """Lines of a page: (text, tags met since the line before, region, whether in an article).

    Elements that are `marked` are read too; `finish` leaves out those that hold neither
    the page's articles nor most of its text.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, bool]] = []
        self.line_marks: list[int] = []
        self.open: list[tuple[str, bool, int, bool, int]] = []  # name, unwanted, region, in an article, innermost marked element
        self.above = [0]  # per region the one around it
        self.names = [""]
        self.mark_above = [0]
        self.articles: list[int] = []  # innermost marked element around each
        self.parts: list[str] = []
        self.tags = self.regions = 0

    def _state(self) -> tuple[bool, int, bool, int]:
        return self.open[-1][1:] if self.open else (False, 0, False, 0)

    def _end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts.clear()
        if text:
            _, region, article, mark = self._state()
            self.lines.append((text, self.tags, region, article))
            self.line_marks.append(mark)
            self.tags = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        # The end tag of the head may be left out.
        if (tag == "body" and any(e[0] == "head" for e in self.open)) or (tag not in IN_HEAD and self.open and self.open[-1][0] == "head"):
            self._close("head")
        skip, region, article, mark = self._state()
        attributes = dict(attrs)
        self.tags += not (skip or unwanted(tag, attributes, article))
        if tag not in INLINE:
            self._end_line()
        if tag in VOID:
            return
        if tag == "p" or tag == "li":  # these close the one before
            self._close(tag, barrier=REGION | {"ul", "ol", "table", "blockquote"})
            skip, region, article, mark = self._state()
        skip = skip or unwanted(tag, attributes, article)
        if not skip and marked(tag, attributes, article):
            self.mark_above.append(mark)
            mark = len(self.mark_above) - 1
        if tag in REGION and not skip:
            self.regions += 1
            self.above.append(region)
            self.names.append(tag)
            region = self.regions
            if tag in ARTICLE or (attributes.get("role") or "") in ("main", "article") or (attributes.get("itemprop") or "").lower() == "articlebody":
                article = True
                self.articles.append(mark)
        self.open.append((tag, skip, region, article, mark))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash in a start tag means nothing in HTML

    def _close(self, tag: str, barrier: frozenset[str] | set[str] = frozenset()) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self._end_line()
                del self.open[k:]
                return
            if self.open[k][0] in barrier:
                return

    def handle_endtag(self, tag: str) -> None:
        self.tags += not self._state()[0]
        if tag in VOID:
            if tag == "br":
                self._end_line()
            return
        if tag not in INLINE:
            self._end_line()
            self._close(tag)
        else:
            # An inline end tag closes nothing beyond the block it is in.
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] == tag:
                    del self.open[k]
                    return
                if self.open[k][0] not in INLINE:
                    return

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] == "head" and data.strip():
            self._close("head")
        if not self._state()[0]:
            self.parts.append(data)

    def finish(self) -> list[tuple[str, int, int, bool]]:
        self.close()
        self._end_line()
        gone = self._passed_over()
        kept = [x for x, m in zip(self.lines, self.line_marks, strict=True) if not gone.intersection(self._marks(m))]
        return kept or self.lines

    def path(self, region: int) -> list[int]:
        """A region and those around it, up to the page."""
        out = [region]
        while region:
            region = self.above[region]
            out.append(region)
        return out

    def around(self, regions: set[int], lines: list[tuple[str, int, int, bool]]) -> int:
        """The smallest region that holds all of these; for one of several sections, or of several divisions of one line each, what holds them."""
        paths = [self.path(r) for r in regions]
        shared = set(paths[0]).intersection(*paths[1:])
        whole = next(r for r in paths[0] if r in shared)
        held: dict[int, list[tuple[str, int, int, bool]]] = {}
        for line in lines:
            for r in self.path(line[2]):
                held.setdefault(r, []).append(line)
        while whole:
            alike = [held[r] for r in held if r not in (0, whole) and self.above[r] == self.above[whole] and self.names[r] == self.names[whole]]
            if self.names[whole] != "section":
                # A line of links is a menu, not a paragraph.
                alike = [x for x in alike if len(x) == len(held[whole]) == 1 and len(x[0][0]) >= PER_LINK * x[0][1]]
            if not alike:
                break
            whole = self.above[whole]
        return whole

    def _marks(self, mark: int) -> list[int]:
        out = []
        while mark:
            out.append(mark)
            mark = self.mark_above[mark]
        return out

    def _passed_over(self) -> set[int]:
        """Marked elements that are no part of the article: another article stands beside them, or they hold none and little text."""
        n = len(self.mark_above)
        inside = np.zeros(n, np.int64)
        for line, mark in zip(self.lines, self.line_marks, strict=True):
            inside[self._marks(mark)] += len(line[0])
        total, gone = sum(len(x[0]) for x in self.lines), set()
        around = [set(self._marks(m)) for m in self.articles]
        for mark in range(1, n):
            outer = set(self._marks(mark)) - {mark}
            beside = any(a <= outer for a in around)
            if beside or not (any(mark in a for a in around) or 2 * inside[mark] > total):
                gone.add(mark)
        return gone


def content_lines(lengths: np.ndarray, tags: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Lines whose text-to-tag ratio, smoothed along the page, is in the upper of two clusters.

    A Gaussian raises short lines amid long ones and sinks lone long lines. The two
    clusters start at the least and the greatest value and are refined by means
    (Weninger, Hsu, Han 2010). Of the lines found those whose own ratio is as high are
    returned, if there are any: a list of links beside a long paragraph is not.
    """
    ratio = lengths / np.maximum(tags, 1)
    reach = math.ceil(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    inside = slice(reach, len(ratio) + reach)
    # The same weights at the ends of the page, over the lines that are there.
    smooth = np.convolve(ratio, kernel)[inside] / np.convolve(np.ones(len(ratio)), kernel)[inside]
    low, high = smooth.min(), smooth.max()
    for _ in range(100):
        upper = smooth >= (low + high) / 2
        if upper.all():
            break
        now = smooth[~upper].mean(), smooth[upper].mean()
        if now == (low, high):
            break
        low, high = now
    bound = (low + high) / 2
    found = smooth >= bound
    own = found & (ratio >= bound)
    return own if own.any() else found


def main_text(html: str) -> str:
    """The article of a page as one line.

    Elements that are never content are passed over while parsing. The other lines are
    clustered by smoothed text-to-tag ratio, and the regions (article, section, division,
    cell) that hold lines of the upper cluster are content. If some of these lie in an
    article, the page's content is all its articles, else it is all lines of the smallest
    region around the lines of the upper cluster and all long lines.
    """
    # A page may be cut off within a tag.
    opened = html.rfind("<")
    if opened > html.rfind(">") and re.match(r"<[a-zA-Z/!?]", html[opened:opened + 2]):
        html = html[:opened]
    parser = Lines()
    parser.feed(html)
    lines = parser.finish()
    if not lines:
        return ""
    content = content_lines(np.array([len(x[0]) for x in lines]), np.array([x[1] for x in lines]))
    regions = {x[2] for x, c in zip(lines, content, strict=True) if c}
    if any(x[3] and x[2] in regions for x in lines):
        return " ".join(x[0] for x in lines if x[3])
    whole = parser.around(regions | {x[2] for x in lines if len(x[0]) >= PARAGRAPH and len(x[0]) >= PER_TAG * x[1]}, lines)
    return " ".join(x[0] for x in lines if whole in parser.path(x[2]))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars) for every page: its main text and its number of code points.

    A null or empty page, and one without content, has an empty text. Character
    references are decoded, white space inside a line becomes one space, lines are joined
    by one space. Each row is worked on alone, so repeated rows and null ids are like any.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h or "") for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()),
                                              pa.array(map(len, texts), pa.int64())], ["id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)[id_col]
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"id {kind}, url string, text string, n_chars bigint").toDF(id_col, url_col, "text", "n_chars")
