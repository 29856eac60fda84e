"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams a page's events. Block boundaries cut it into lines; each line has its text, its
tags and its link text. Lines below menus, headers, footers, side bars, notices, adverts, forms, scripts, styles and
reader comments (by element, role, class or id) have no text. A line's ratio is its characters outside
links over its tags; the ratios are smoothed by a Gaussian over neighbouring lines, and lines above a threshold
(the spread of the smoothed ratios, at most half their mean) form the content clusters. The article is the innermost
container that holds all cluster text, with all its lines but link lists, so that short paragraphs between
long ones stay.

Text: character references decoded, white space inside a block as one space, ends trimmed, blocks joined in page order
by one space. Nothing else is dropped or cut.

Defined results: null and empty pages and pages without content give an empty text; unclosed and stray tags are
accepted, an open head ends where something starts that cannot be in a head; a page without any markup is its own text; extra columns stay, `main_text` is replaced if there.
"""

from __future__ import annotations

from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query, read

# Elements of HTML, and words that name parts beside an article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset
    h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul""".split())
CONTAINER = frozenset("html body main article section div td center blockquote".split())
BESIDE = frozenset("""head title script style noscript template nav header footer aside form menu dialog button select textarea input iframe object
    embed svg math canvas audio video applet datalist""".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar status".split())
WORDS = frozenset("""ad ads advert adverts advertisement advertising banner sponsor sponsored promo promos promotion sidebar nav navbar navigation menu
    menus breadcrumb breadcrumbs footer header masthead comment comments commentlist reply replies discussion disqus respond cookie cookies consent
    gdpr notice notices alert popup modal newsletter subscribe subscription signup share sharing social related recommended recommendations widget
    widgets toolbar pagination pager login search copyright disclaimer skip""".split())
REMARKS = frozenset("comment comments commentlist reply replies discussion disqus respond".split())
CLOSES_P = BLOCK - {"br", "html", "body"}
IN_HEAD = frozenset("html base basefont bgsound link meta title style script noscript noframes template".split())
_WORD = regex.compile(r"[A-Za-z]+")
SIGMA = 1.5


class Lines(HTMLParser):
    """Collects lines: text, tags, link characters and container."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.open = [], Counter()  # (tag, container, beside, link)
        self.parent, self.kind, self.lines, self.h1 = [-1], ["html"], [], None
        self.parts, self.tags, self.links = [], 0, 0
        self.container, self.beside, self.link, self.heading = 0, False, False, False

    def _line(self) -> None:
        text = " ".join("".join(self.parts).split()) if self.parts else ""
        if text:
            if self.heading and self.h1 is None:
                self.h1 = self.container
            self.lines.append((text, self.tags, self.links, self.container))
            self.tags = 0
        self.parts, self.links = [], 0

    def handle_starttag(self, tag: str, attrs) -> None:
        if self.open["head"] and (tag == "body" and not self.open["template"] or self.stack[-1][0] == "head" and tag not in IN_HEAD):
            self._close("head")  # its end tag may be left out
        if tag in BLOCK:
            self._line()
            if tag in CLOSES_P and self.open["p"]:
                self._close("p")
        self.tags += 1
        if tag in VOID:
            return
        if tag in ("li", "tr", "td", "th", "dt", "dd", "option") and self.stack and self.stack[-1][0] == tag:
            self._close(tag)
        beside = self.beside or self._is_beside(tag, attrs)
        self.stack.append((tag, self.container, self.beside, self.link, self.heading))
        self.open[tag] += 1
        if tag in CONTAINER and not beside:
            self.parent.append(self.container)
            self.kind.append(tag)
            self.container = len(self.parent) - 1
        self.beside, self.link, self.heading = beside, self.link or tag == "a", self.heading or tag == "h1"

    def _is_beside(self, tag: str, attrs) -> bool:
        if tag in ("html", "body", "main"):
            return False
        if tag == "header" and (self.open["article"] or self.open["main"]):
            return False
        if tag in BESIDE:
            return True
        words = WORDS if tag != "article" else REMARKS
        for name, value in attrs:
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return True
            if not value:
                continue
            if name == "role" and value.lower() in ROLES:
                return True
            if name in ("class", "id") and any(w.lower() in words for w in _WORD.findall(value)):
                return True
            if name == "style" and "display:none" in value.replace(" ", "").lower():
                return True
        return False

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK:
            self._line()
        self._close(tag)

    def _close(self, tag: str) -> None:
        if not self.open[tag]:
            return
        while True:
            last, self.container, self.beside, self.link, self.heading = self.stack.pop()
            self.open[last] -= 1
            if last == tag:
                return

    def handle_data(self, data: str) -> None:
        if self.beside and self.stack[-1][0] == "head" and data.strip():
            self._close("head")
        if not self.beside:
            self.parts.append(data)
            if self.link:
                self.links += len(data)


def smooth(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian mean over neighbouring lines; at the ends over those that are there."""
    radius = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return np.convolve(ratios, kernel)[radius:radius + len(ratios)] / np.convolve(np.ones(len(ratios)), kernel)[radius:radius + len(ratios)]


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.close()
    page._line()
    if not page.lines:
        return ""
    size = np.array([len(x[0]) for x in page.lines], float)
    links = np.array([x[2] for x in page.lines], float)
    where = np.array([x[3] for x in page.lines])
    ratios = smooth(np.maximum(size - links, 0) / np.maximum([x[1] for x in page.lines], 1))
    threshold = min(ratios.std(), ratios.mean() / 2)
    content = ratios >= threshold
    held = np.zeros(len(page.parent))  # cluster text below each container
    np.add.at(held, where, np.where(content, np.maximum(size - links, 0), 0))
    for c in range(len(page.parent) - 1, 0, -1):
        held[page.parent[c]] += held[c]
    children = {}
    for c in range(1, len(page.parent)):
        p = page.parent[c]
        if p not in children or held[c] > held[children[p]]:
            children[p] = c
    titled, at = set(), page.h1
    while at is not None and at >= 0:  # containers with the first main heading
        titled.add(at)
        at = page.parent[at]
    best = 0
    while best in children and page.kind[best] not in ("article", "main"):
        inner = children[best]
        if held[inner] <= 0 or held[inner] < held[best] or (titled and inner not in titled and page.kind[inner] not in ("article", "main")):
            break
        best = inner
    if page.kind[best] == "main":  # an article inside, if it has all
        found = [c for c in range(best + 1, len(page.parent)) if page.kind[c] == "article" and held[c] == held[best] > 0]
        best = found[0] if found else best
    inside = np.zeros(len(page.parent), bool)
    inside[best] = True
    for c in range(best + 1, len(page.parent)):
        inside[c] = inside[page.parent[c]]
    keep = inside[where] & (content | (links <= size / 2))
    return " ".join(x[0] for x, k in zip(page.lines, keep) if k)


def extract(html: Column) -> Column:
    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(main_text)
    return run(html)


def with_main_text(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """All rows and columns, with main_text."""
    return pages.withColumn("main_text", extract(F.col(html_column)))


@query("op1_html_main")
def op1(spark: SparkSession, root: str) -> DataFrame:
    done = with_main_text(read(spark, root, "pages"))
    return done.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("bigint").alias("n_chars"))
