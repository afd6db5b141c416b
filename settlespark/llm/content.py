"""Main text of web pages by text-to-tag ratios, smoothed over the lines of a page and clustered."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

STEP = 1 << 16

# Fixed values of HTML: elements without content, those that break a line, those that never hold an article.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
            "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot "
            "thead tr ul".split())
APART = set("aside button canvas dialog embed footer form head iframe input map math menu nav noscript object option script select style svg "
            "template textarea title audio video".split())
REGION = set("article main section div td th body blockquote".split())
# Names that pages give to what surrounds an article, as words of class and id.
NAMES = set("ad ads advert adverts advertisement advertisements sponsor sponsored promo promoted promotion nav navbar navigation menu "
            "breadcrumb breadcrumbs pagination pager sidebar aside widget widgets rail related recommended recommendations trending share "
            "sharing social toolbar footer copyright legal cookie cookies consent gdpr notice notices banner alert popup modal overlay "
            "newsletter subscribe subscription signup login search comment comments disqus reply replies responses respond discussion".split())
# Words that stand beside such a name in one class and say nothing of their own.
GENERIC = set("area bar block box btn button buttons card container content group holder inner item items link links list outer panel post posts row "
              "section slot tag text title top unit wrap wrapper zone".split())
COMMENT_IDS = set("comments disqus_thread respond".split())
HEADERS = set("header masthead topbar".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_PART = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")


@dataclass
class Line:
    """Text between two breaks, the tags met with it, and the region it stands in."""

    pieces: list[str] = field(default_factory=list)
    tags: int = 0
    region: int = 0
    weight: float = 1.0
    text: str = ""


class Lines(HTMLParser):
    """Collects the lines of a page from parser events; only open elements and lines are held."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int, bool]] = []  # name, apart, region, within an article
        self.lines: list[Line] = []
        self.regions, self.line = 0, Line()

    def _top(self) -> tuple[bool, int, bool]:
        return self.open[-1][1:] if self.open else (False, 0, False)

    def flush(self) -> None:
        self.line.text = " ".join("".join(self.line.pieces).split())
        if self.line.text:
            self.lines.append(self.line)
            self.line = Line()
        else:
            self.line.pieces.clear()
        apart, region, article = self._top()
        self.line.region, self.line.weight = region, 0.0 if apart else 10.0 if article else 1.0

    def handle_starttag(self, tag, attrs):
        if tag in ("body", "article", "main"):  # a head or menu that was left open ends here
            while self.open and self.open[-1][0] in ("head", "title", "style"):
                self.open.pop()
        if tag in BLOCK:
            if tag in ("p", "li", "dd", "dt", "tr", "option"):
                self._end_open(tag)
            self.flush()
        self.line.tags += 1
        if tag in ("br", "td", "th"):
            self.line.pieces.append(" ")
        if tag in VOID:
            return
        apart, region, article = self._top()
        apart = apart or self._named_apart(tag, dict(attrs), article)
        if tag in ("article", "main") and not article:
            self.regions += 1
            region, article = self.regions, True
        elif tag in REGION and not article:
            self.regions += 1
            region = self.regions
        self.open.append((tag, apart, region, article))
        if tag in BLOCK:
            self.flush()
        elif apart:
            self.line.weight = self.line.weight if self.line.pieces else 0.0

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK:
            self.handle_endtag(tag)

    def _end_open(self, tag: str) -> None:
        """Closes an element of this name that HTML ends by itself, unless a region lies between."""
        for i in range(len(self.open) - 1, -1, -1):
            name = self.open[i][0]
            if name == tag:
                del self.open[i:]
                return
            if name in REGION or name in ("ul", "ol", "dl", "table", "select"):
                return

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.flush()
        self.line.tags += 1
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break
        if tag in BLOCK:
            self.flush()

    def handle_data(self, data):
        if self.open and self._top()[0] and self.open[-1][0] not in BLOCK and not self._in_block_apart():
            return  # an inline element set apart within a line of the article
        self.line.pieces.append(data)

    def _in_block_apart(self) -> bool:
        """Whether the nearest block around is set apart itself."""
        for name, apart, _, _ in reversed(self.open):
            if name in BLOCK:
                return apart
        return False

    @staticmethod
    def _named_apart(tag: str, attrs: dict, article: bool) -> bool:
        if tag in APART or tag == "header" and not article or "hidden" in attrs or attrs.get("aria-hidden") == "true":
            return True
        if (attrs.get("role") or "").lower() in ROLES or "display:none" in (attrs.get("style") or "").replace(" ", "").lower():
            return True
        if tag in ("html", "body", "main"):
            return False
        if article:
            # What an article is about may use the same words: only whole classes count in it, and no id but a comment list's.
            classes = [{p.lower() for p in _PART.findall(c)} for c in (attrs.get("class") or "").split()]
            return any(c & NAMES and c <= NAMES | GENERIC for c in classes) or (attrs.get("id") or "").lower() in COMMENT_IDS
        names = {p.lower() for key in ("class", "id") for p in _PART.findall(attrs.get(key) or "")}
        return bool(names & NAMES or names & HEADERS)


def lines_of(html: str) -> list[Line]:
    parser = Lines()
    for i in range(0, len(html), STEP):
        parser.feed(html[i:i + STEP])
    parser.close()
    parser.flush()
    return parser.lines


def smoothed(values: np.ndarray, sigma: float = 1.5) -> np.ndarray:
    """Gaussian mean over neighbours, weights renewed at the ends."""
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(values, kernel)[reach:-reach] / np.convolve(np.ones(len(values)), kernel)[reach:-reach]


def threshold(values: np.ndarray) -> float:
    """The border between the two clusters of 2-means on a line; below all values if they are alike."""
    low, high = values.min(), values.max()
    if high - low < 1e-9:
        return low - 1
    for _ in range(100):
        cut = (low + high) / 2
        left, right = values[values <= cut], values[values > cut]
        new = (left.mean(), right.mean())
        if abs(new[0] - low) + abs(new[1] - high) < 1e-9:
            break
        low, high = new
    return (low + high) / 2


def extract(html: str | None) -> str:
    """The lines of the page's content regions, joined by line breaks; empty if there are none.

    A line's ratio is its characters over its tags; markup that declares a line boilerplate
    makes it 0, markup that declares an article multiplies it. Smoothed logs of the ratios
    fall into two clusters. A region is content if lines of the upper cluster hold half of its
    text; if none is, the one with most weighted text is taken. All from the first to the last line
    of these regions is kept, short lines included. A page that declares articles leaves nothing
    to decide: all of them are kept whole, but for what is set apart in them.
    """
    lines = lines_of(html or "")
    ratios = np.array([line.weight * len(line.text) / max(1, line.tags) for line in lines])
    if not len(lines) or not ratios.any():
        return ""
    smooth = smoothed(np.log1p(ratios))
    upper = smooth > threshold(smooth)
    sizes: dict[int, list[float]] = {}
    for line, is_upper in zip(lines, upper):
        if line.weight:
            size = sizes.setdefault(line.region, [0.0, 0.0, 0.0])
            size[0] += len(line.text)
            size[1] += len(line.text) * is_upper
            size[2] += len(line.text) * line.weight
    articles = {line.region for line in lines if line.weight > 1}
    if articles:
        return "\n".join(line.text for line in lines if line.weight and line.region in articles)
    chosen = {r for r, (n, inside, _) in sizes.items() if 2 * inside >= n} or {max(sizes, key=lambda r: sizes[r][2])}
    # A bare page may cut its article into many regions: what lies between two of them belongs to it.
    places = [i for i, line in enumerate(lines) if line.weight and line.region in chosen]
    return "\n".join(line.text for line in lines[places[0]:places[-1] + 1] if line.weight)


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)``, one row per page. A null page, like one without content, has an empty text."""
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([extract(p) for p in pages], dtype=object)

    run.__annotations__ = {"pages": pd.Series, "return": pd.Series}
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.pandas_udf("string")(run)(F.col(html_col)).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
