"""Main text of web pages by text-to-tag ratio (after Weninger, Hsu and Han, 2010), over parser events.

1. The standard library's streaming parser cuts a page into lines at block elements.  A line's ratio is its code points
   a tag, times a weight, on a logarithmic scale: what stands in menus, forms and other furniture (by element name, or by a class, id or role
   that says so) weighs little, what stands in an article or main element more.  A weight never decides by itself: only
   ratios of one page are compared, so a page that stands whole in a form or under a misleading class loses nothing.
2. Ratios are smoothed along the page with a Gaussian kernel.  The threshold is a share of their standard deviation:
   lines above it are content.
3. Lines of one container and one weight are a cluster.  A cluster is chosen if a good part of its text is content and
   its ratio as a whole is above a share of the page's mean (by letters); then all its lines are, so that an article keeps
   its short paragraphs.  A content line whose own ratio is above that stays without its cluster.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark math mfrac mi mn mo mrow msqrt mstyle msub msubsup msup mtext q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
SILENT = frozenset("head script style noscript template svg canvas iframe object audio video".split())
FURNITURE = frozenset("nav footer aside form button select textarea menu dialog fieldset".split())
CONTAINERS = frozenset("article main section div td body center header".split()) | FURNITURE
CLOSE_P = frozenset(
    "address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dt dd td th tr".split()
)
SHUTS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
#: A class, id or role says furniture if one of these is a whole name in it ...
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices popup modal nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside footer header masthead comment comments replies disqus share sharing social related recommended recommendations newsletter subscribe login signup search pagination pager toolbar widget complementary contentinfo alert commentlist respond responses colophon site-info siteinfo discussion-list discussion-thread".split()
)
#: ... or if all parts between hyphens and underscores are such names or these.
PLACES = frozenset("site page main global left right top bottom list box bar block container wrapper area section links primary secondary user reader wrap inner outer slot unit body entry item thread info".split())
WHITE, PARTS = re.compile(r"\s+"), re.compile(r"[-_]+")
#: Weights of furniture and of articles.
LITTLE, MUCH = 0.002, 3.0


def says_furniture(names: str | None) -> bool:
    for name in (names or "").lower().split():
        parts = [p for p in PARTS.split(name) if p]
        if name in MARKS or any(p in MARKS for p in parts) and all(p in MARKS or p in PLACES or p.isdigit() for p in parts):
            return True
    return False


class Lines(HTMLParser):
    """Collects lines: text, tags in it, innermost container (a number; ``parents`` has those around, ``kinds`` their
    names), weight, letters in links."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        # of each open element: name, silent, innermost container, weight, in an article
        self.stack: list[tuple[str, bool, int, float, bool]] = [("", False, 0, 1.0, False)]
        self.open: Counter[str] = Counter()
        self.parents, self.kinds, self.text, self.tags, self.linked = [0], [""], [], 0, 0
        self.lines: list[tuple[str, int, int, float, int]] = []

    def cut(self) -> None:
        text = WHITE.sub(" ", "".join(self.text)).strip()
        if text or self.tags:
            self.lines.append((text, self.tags, self.stack[-1][2], self.stack[-1][3], min(self.linked, len(text))))
        self.text, self.tags, self.linked = [], 0, 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CLOSE_P:
            self._close("p", CONTAINERS | {"li", "table"})
        if tag in SHUTS:
            for other in {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,)):
                self._close(other, SHUTS[tag])
        if tag not in INLINE:
            self.cut()
        self.tags += 1
        if tag == "br":
            self.text.append("\n")  # white space inside its block
        if tag in VOID:
            return
        _, silent, inside, weight, article = self.stack[-1]
        if tag in ("article", "main") and not article:
            weight, article = weight * MUCH, True
        furniture = tag in FURNITURE or tag == "header" and not article
        if not furniture and tag not in ("body", "html", "article", "main"):
            furniture = any(k in ("class", "id", "role") and says_furniture(v) or k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs)
        if furniture:
            weight = max(weight * LITTLE, 1e-200)
        if tag in CONTAINERS:
            self.parents.append(inside)
            self.kinds.append(tag)
            inside = len(self.parents) - 1
        self.stack.append((tag, silent or tag in SILENT, inside, weight, article))
        self.open[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.cut()
        self.tags += 1
        self._close(tag, frozenset() if tag in CONTAINERS or tag in ("html", "head", "table", "ul", "ol") else CONTAINERS)

    def _close(self, tag: str, within: frozenset | set) -> None:
        """Closes the innermost open ``tag``, if it stands inside the innermost of ``within``."""
        if not self.open[tag]:
            return
        for k in range(len(self.stack) - 1, 0, -1):
            name = self.stack[k][0]
            if name == tag:
                if tag in INLINE:
                    del self.stack[k]  # what else is open stays open
                    self.open[tag] -= 1
                else:
                    self.cut()
                    self.open.subtract(x[0] for x in self.stack[k:])
                    del self.stack[k:]
                return
            if name in within:
                return

    def handle_data(self, data: str) -> None:
        if not self.stack[-1][1]:
            self.text.append(data)
            if self.open["a"]:
                self.linked += len(data.strip())


def smooth(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing along the lines, with weights that sum to one at the ends as well."""
    radius = max(1, int(np.ceil(2 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    n = len(ratios)
    return np.convolve(ratios, kernel)[radius : radius + n] / np.convolve(np.ones(n), kernel)[radius : radius + n]


def owners(inside: list[int], parents: list[int]) -> np.ndarray:
    """The container of each line: the innermost with another line in it, so that a div a paragraph is no cluster alone."""
    held = np.bincount(inside, minlength=len(parents)).tolist()
    for c in range(len(parents) - 1, 0, -1):  # parents have smaller numbers
        held[parents[c]] += held[c]
    up = [0] * len(parents)
    for c in range(1, len(parents)):
        up[c] = c if held[c] > 1 else up[parents[c]]
    return np.array([up[c] for c in inside], np.int64)


def followers(which: np.ndarray, good: np.ndarray, sizes: np.ndarray, linked: np.ndarray, page: Lines, links: float = 0.5) -> np.ndarray:
    """The clusters (container, weight) that follow one around them: chosen itself, or an article that mostly is."""
    of = {(int(c), w): k for k, (c, w) in enumerate(which.T)}
    within: dict[tuple[int, float], np.ndarray] = {}  # letters, and those chosen, of articles by weight
    for (c, w), k in of.items():
        while c:
            if page.kinds[c] in ("article", "main"):
                within[c, w] = within.get((c, w), np.zeros(2)) + sizes[k] * np.array([1, good[k]])
            c = page.parents[c]
    out = np.zeros(len(good), bool)
    for (c, w), k in of.items():
        if good[k] or linked[k] > links * sizes[k]:
            continue
        while c and page.kinds[c] != "body":
            all_, chosen = within.get((c, w), (0, 0))
            if (c, w) in of and good[of[c, w]] or 2 * chosen > all_:
                out[k] = True
                break
            c = page.parents[c]
    return out


def main_text(html: str | None, sigma: float = 1.0, share: float = 0.5, majority: float = 0.4) -> str:
    """The blocks of main text in page order, joined by newlines; empty for null, empty or textless pages."""
    page = Lines()
    page.feed(html or "")
    page.close()
    page.cut()
    if not any(x[0] for x in page.lines):
        return ""
    sizes, tags, weights = (np.array([f(x) for x in page.lines], float) for f in (lambda x: len(x[0]), lambda x: max(1, x[1]), lambda x: x[3]))
    full = sizes > 0
    weights /= weights[full].max()  # what the whole page stands in doesn't count
    ratios = np.log1p(weights * sizes / tags)  # the logarithm, as one huge line would lift the threshold above all others
    smoothed = smooth(ratios, sigma)
    level = share * smoothed.std()
    content = (smoothed >= level) & full
    own = share * np.average(ratios, weights=sizes)  # what a cluster needs as a whole, unsmoothed: a share of the mean over all letters
    which, cluster = np.unique(np.stack([owners([x[2] for x in page.lines], page.parents), weights]), axis=1, return_inverse=True)
    cluster = cluster.ravel()
    total = lambda x: np.bincount(cluster, x)
    as_whole = np.log1p(total(weights * sizes) / np.maximum(1, total(tags * full)))
    good = (total(sizes * content) >= majority * np.maximum(1, total(sizes))) & (as_whole >= own)
    good |= followers(which, good, total(sizes), total(np.array([x[4] for x in page.lines], float)), page)
    chosen = good[cluster] | (content & (ratios >= own))
    return "\n".join(x[0] for x, yes in zip(page.lines, chosen) if yes and x[0])


def extract(pages: DataFrame, **how) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html), each judged alone: no shuffle.

    A br is white space inside its block.  Null and empty html give empty text and 0; rows that repeat a page_id each
    get a row; other columns are left out.
    """
    run = common.arrow_rows([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())], lambda i, u, h: (i, u, main_text(h, **how)))
    found = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
