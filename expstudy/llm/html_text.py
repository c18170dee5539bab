"""Main text of web pages: parser events, text-to-tag ratios, smoothing, clustering.

The standard library's streaming parser cuts a page into lines, one for each stretch of text
between block-level tags.  A line's ratio is its characters over its tags.  The ratios are
smoothed by a Gaussian over neighbouring lines and split by two-means clustering; lines of the
upper cluster that are not page furniture are seeds.  The content region is the deepest element
that holds nearly all seed text; where the page marks an article (or main) element with seed text
in or around that region, the mark settles its edges, and a mark elsewhere is passed over.  The
text is every line of the region but furniture: menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles, reader comments, by tag, class, id or role.  A class,
id or role marks furniture if it is a known name as a whole, or begins or ends with one; where
that leaves a doubt (``DOUBTFUL`` names, and ids inside the marked article) the element goes only
if most of its text is in links or its own ratio is in the lower cluster.  Headings are not
judged by their ids, which are often made from their text.  Where the page marks no article,
lists of links in the region's lower cluster go too.

Each page is read once, front to back, in time and memory proportional to its length; pages
are rows of a mapInArrow, so a lost task repeats its pages only.

Cases: a null or empty page, or one without content, has the empty text; cut-off pages are read
to their end, a tag that is cut off is markup; a null page_id or url passes through; repeated
rows are extracted each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from expstudy.llm.common import batched

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(("address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer "
                   "form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th "
                   "thead tr ul").split())
#: Elements without any readable text, and those that are furniture wherever they stand.
MUTE = frozenset("head script style noscript template title iframe object svg canvas audio video math textarea datalist".split())
FURNITURE = frozenset("nav footer aside form button select dialog menu input label fieldset".split())
#: Words of a class, id or role that mark furniture; not on the elements of WHOLE.
NAMES = frozenset(("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion "
                   "nav navbar navigation menu menubar breadcrumb breadcrumbs pager pagination toolbar topbar masthead header "
                   "banner footer contentinfo copyright legal sidebar complementary widget rail related recommended "
                   "notice notices cookie cookies consent gdpr alert alertdialog popup modal overlay dialog paywall "
                   "comment comments commentlist reply replies respond responses disqus discussion share sharing social "
                   "newsletter subscribe subscription signup login search form").split())
#: Those of NAMES that article text is also about: alone they mark furniture, as a part they leave a doubt.
DOUBTFUL = frozenset(("legal related recommended social search share sharing notice notices alert reply replies respond responses "
                      "discussion header form banner promotion navigation copyright login signup subscription dialog complementary").split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WHOLE = frozenset("html body main article".split())
COMMENTS = frozenset("comment comments reply replies".split())
MAIN_ROLES = frozenset(("main", "article"))
NEGATED = frozenset(("has", "no", "with", "without"))
_NAME, _CAMEL = re.compile(r"[a-z]+(?:-[a-z]+)*"), re.compile(r"(?<=[a-z])(?=[A-Z])")
SIGMA, REACH = 1.0, 3
#: Elements that a region without a marked article can be.
HOLDERS = frozenset("html body div section center table tbody tr td".split())
#: Share of the seed text that a child must hold for the region to narrow to it.
NEARLY_ALL = 0.8


class _Page(HTMLParser):
    """Lines of a page; elements are numbered in the order in which they open."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parent, self.furniture, self.article, self.holder = [-1], [False], [0], [True]  # element 0: the page
        self.doubt = [0]  # the outermost doubtful element around each, 0 without one
        self.stack: list[tuple[str, int]] = []
        self.open: Counter[str] = Counter()
        self.mute = self.links = 0
        self.lines: list[tuple[str, int, int, int]] = []  # text, tags, characters in links, element
        self.words: list[str] = []
        self.tags = self.link_chars = 0

    def here(self) -> int:
        return self.stack[-1][1] if self.stack else 0

    def flush(self) -> None:
        if self.words and (text := " ".join("".join(self.words).split())):
            self.lines.append((text, self.tags, self.link_chars, self.here()))
            self.tags = 0
        self.words, self.link_chars = [], 0

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCK:
            self.flush()
            if self.open["p"]:
                self.close_to("p")
        if tag in VOID:
            return
        up, names, doubts, role, hidden = self.here(), set(), set(), "", False
        for k, v in attrs:
            if k in ("class", "id", "role") and v:
                for word in _NAME.findall(_CAMEL.sub("-", v).lower().replace("_", "-")) if k != "id" or tag not in HEADINGS else ():
                    parts, inner = word.split("-"), k == "id" and self.article[up] > 0
                    if len(parts) == 1:
                        (doubts if inner and word in DOUBTFUL else names).add(word)
                    elif parts[0] not in NEGATED:
                        for part in (parts[0], parts[-1]):
                            (doubts if inner or part in DOUBTFUL else names).add(part)
                role = v.lower() if k == "role" else role
            elif k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and re.search(r"display\s*:\s*none", v):
                hidden = True
            elif k == "itemprop" and v == "articleBody":
                role = "main"
        own = tag in FURNITURE or hidden or bool(names & (COMMENTS if tag in WHOLE or role in MAIN_ROLES else NAMES))
        own |= tag == "header" and not self.article[up]
        doubt = not own and not self.doubt[up] and bool(doubts & NAMES) and tag not in WHOLE and role not in MAIN_ROLES
        if own and not self.furniture[up] or doubt:
            self.flush()
        n = len(self.parent)
        self.parent.append(up)
        self.furniture.append(own or self.furniture[up])
        self.doubt.append(n if doubt else self.doubt[up])
        inner = 2 if tag == "article" or role == "article" else 1 if tag == "main" or role == "main" else 0
        self.article.append(max(inner, self.article[up]))
        self.holder.append(tag in HOLDERS)
        self.stack.append((tag, n))
        self.open[tag] += 1
        self.mute += tag in MUTE
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # as browsers do: "/" closes only void elements

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.flush()
        self.tags += 1
        if self.open[tag]:
            self.close_to(tag)

    def close_to(self, tag: str) -> None:
        while True:
            name, n = self.stack[-1]
            if self.furniture[n] and not self.furniture[self.parent[n]] or self.doubt[n] == n:
                self.flush()
            self.stack.pop()
            self.open[name] -= 1
            self.mute -= name in MUTE
            self.links -= name == "a"
            if name == tag:
                return

    def handle_data(self, data):
        if not self.mute:
            self.words.append(data)
            if self.links:
                self.link_chars += len(data)


def _smooth(x: np.ndarray) -> np.ndarray:
    k = np.exp(-0.5 * (np.arange(-REACH, REACH + 1) / SIGMA) ** 2)
    return np.convolve(x, k, "full")[REACH:REACH + len(x)] / np.convolve(np.ones(len(x)), k, "full")[REACH:REACH + len(x)]


def _threshold(x: np.ndarray) -> float:
    """Midway between the centres of two clusters; the least value if there is only one."""
    low, high = float(x.min()), float(x.max())
    if low == high:
        return low
    for _ in range(50):
        cut = (low + high) / 2
        new = float(x[x < cut].mean()), float(x[x >= cut].mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def _settle(page: _Page, cut: float) -> None:
    """Makes the doubtful elements furniture whose text is mostly links or whose ratio is below ``cut``."""
    sums: dict[int, list[int]] = {}
    for text, tags, links, element in page.lines:
        if (d := page.doubt[element]) and not page.furniture[element]:
            own = sums.setdefault(d, [0, 0, 0])
            own[0] += len(text)
            own[1] += tags
            own[2] += links
    gone = {d for d, (size, tags, links) in sums.items() if links > 0.5 * size or size < cut * max(1, tags)}
    if gone:
        page.furniture = [f or d in gone for f, d in zip(page.furniture, page.doubt, strict=True)]


def main_text(html: str | None) -> str:
    """The main text of a page, its blocks joined by single spaces."""
    html = html or ""
    at = html.rfind("<")
    if at >= 0 and html.find(">", at) < 0 and re.match(r"<[a-zA-Z/!?]", html[at:at + 2]):
        html = html[:at]
    page = _Page()
    page.feed(html)
    page.close()
    page.flush()
    lines = page.lines
    if not lines:
        return ""
    size = np.array([len(x[0]) for x in lines], float)
    ratio = _smooth(size / np.maximum(1, [x[1] for x in lines]))
    cut = _threshold(ratio)
    upper = ratio >= cut
    _settle(page, cut)
    useful = np.array([not page.furniture[x[3]] for x in lines])
    if not useful.any():
        return ""
    linked = np.array([x[2] for x in lines]) > 0.5 * size
    seeds = upper & useful & ~linked
    if not seeds.any():
        seeds = useful & ~linked if (useful & ~linked).any() else useful
    n = len(page.parent)
    weight = [0.0] * n
    for x, s, seed in zip(lines, size, seeds, strict=True):
        weight[x[3]] += s * seed
    for e in range(n - 1, 0, -1):  # children have higher numbers than their parents
        weight[page.parent[e]] += weight[e]
    region, heavy = 0, {}
    for e in range(1, n):
        if weight[e] >= NEARLY_ALL * weight[0] and page.holder[e] and not page.furniture[e]:
            heavy[page.parent[e]] = e
    while region in heavy:
        region = heavy[region]
    around = {0}
    e = region
    while e > 0:
        around.add(e)
        e = page.parent[e]
    within = [False] * n
    within[region] = True
    for e in range(region + 1, n):
        within[e] = within[page.parent[e]]
    marked = [e for e in range(1, n) if page.article[e] > page.article[page.parent[e]] and not page.furniture[e] and weight[e] > 0
              and (within[e] or e in around)]
    if marked:
        kind = max(page.article[e] for e in marked)
        region = max((e for e in marked if page.article[e] == kind), key=lambda e: (weight[e], -e))
    inside = [False] * n
    inside[region] = True
    for e in range(region + 1, n):
        inside[e] = inside[page.parent[e]]
    return " ".join(x[0] for x, use, up, link in zip(lines, useful, upper, linked, strict=True)
                    if use and inside[x[3]] and (marked or up or not link))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    batched(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
