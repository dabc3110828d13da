"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing, clustering.

The standard library's parser streams events. Block elements cut the page into lines; each line has
its text and the number of tags met since the line before. Subtrees that by element, role, class or
id are menus, headers, footers, sidebars, notices, adverts, forms or comments give no lines. The
ratio of text to tags is smoothed over neighbouring lines with a Gaussian and lines are split into
content and rest by a threshold; clusters of content lines choose the region. A region is an
``article`` or ``main`` element that holds such a cluster, or, on pages without one, the stretch
from the first to the last content line with a heading just before it. All lines of a region are kept,
the short ones too, but for rows of links outside its clusters. Elements whose end tag may be left out end where HTML says
so, skipped ones too; ``<![`` begins a comment. Where an element that is no such one is never closed, what follows is read again
with articles ending what is skipped, if the page has no other.

A page is a row of its own: no shuffle, no state between rows, a batch of bounded rows in memory.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tallysift.session import table

#: Elements whose content is never main text.
DROPPED = frozenset("head title script style noscript template iframe object svg math canvas nav footer aside form button select textarea datalist dialog menu audio video map".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that stay inside a line.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
REGIONS = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Words of class and id attributes that mark what is not main text.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertis\w*|adsense|adbox|adslot|banner|breadcrumbs?|comments?|commentlist|disqus|respond|replies"
    r"|cookies?|consent|gdpr|notices?|alert|newsletter|subscribe|signup|login|footer|foot|header|masthead|topbar|toolbar|menu|nav|navbar"
    r"|navigation|pagination|pager|promo\w*|sponsor\w*|related|recommend\w*|share|sharing|social|sidebar|widget|popup|modal|overlay|skip-link)(?:$|[\s_-])",
    re.I,
)
#: The same words without those that inside an article mark its own head.
MARKS_INSIDE = re.compile(MARKS.pattern.replace("|footer|foot|header|masthead|", "|footer|foot|"), re.I)
#: Elements whose end tag may be left out: the start tags that end them, and the elements inside which those do not.
BLOCKS = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
LISTS, TABLES = frozenset("ul ol menu".split()), frozenset(("table",))
IMPLIED = {
    "p": (BLOCKS, frozenset(("button", "table", "object"))),
    "li": (frozenset(("li",)), LISTS),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (frozenset(("tr", "tbody", "thead", "tfoot")), TABLES),
    "td": (frozenset(("td", "th", "tr", "tbody", "thead", "tfoot")), TABLES),
    "th": (frozenset(("td", "th", "tr", "tbody", "thead", "tfoot")), TABLES),
    "option": (frozenset(("option", "optgroup")), frozenset(("select",))),
}
#: A line is a row of links if it has so many, and so much of its text is in them.
LINKS, LINKED = 2, 0.8
#: Standard deviation, in lines, and reach of the smoothing.
SIGMA, REACH = 1.0, 3
KERNEL = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(-REACH, REACH + 1)]


class Line:
    __slots__ = ("text", "tags", "region", "heading", "links")

    def __init__(self, text: str, tags: int, region: int, heading: bool, links: bool = False):
        self.text, self.tags, self.region, self.heading, self.links = text, tags, region, heading, links


class Lines(HTMLParser):
    """Collects the lines of a page. ``lenient``: a dropped subtree ends where an article begins."""

    def __init__(self, lenient: bool = False):
        super().__init__(convert_charrefs=True)
        self.lenient = lenient
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.tags = 0
        self.skipped = ""  # the element whose end ends what is skipped
        self.inner: list[str] = []  # elements open inside it
        self.outer: list[str] = []  # elements open around it
        self.link, self.links, self.linked = 0, 0, 0
        self.regions: list[tuple[str, int]] = []
        self.count = 0
        self.heading = False

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts.clear()
            if text:
                links = self.links >= LINKS and self.linked >= LINKED * len(text.replace(" ", ""))
                self.lines.append(Line(text, self.tags, self.regions[0][1] if self.regions else 0, self.heading, links))
                self.tags = 0
        self.links = self.linked = 0

    def unwanted(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in DROPPED or (tag == "header" and not self.regions):
            return True
        for name, value in attrs:
            value = value or ""
            if name == "role" and value.strip().lower() in ROLES:
                return True
            if name in ("class", "id") and tag not in ("html", "body") and (MARKS_INSIDE if self.regions else MARKS).search(value):
                return True
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return True
            if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True
        return False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.skipped:
            ends, walls = IMPLIED.get(self.skipped, (frozenset(), frozenset()))
            if tag in ends and not walls.intersection(self.inner):
                self.skipped = ""
            elif self.lenient and tag in REGIONS and not self.regions and not self.unwanted(tag, attrs):
                self.skipped = ""
            else:
                if tag not in VOID:
                    self.inner.append(tag)
                return
        if tag not in INLINE:
            self.flush()
            self.heading = tag in HEADINGS
        if tag not in VOID and self.unwanted(tag, attrs):
            self.skipped, self.inner = tag, []
            return
        self.tags += 1
        if tag not in VOID:
            self.outer.append(tag)
        if tag == "a":
            self.link += 1
            self.links += 1
        if tag == "br":
            self.parts.append(" ")
        if tag in REGIONS:
            self.count += 1
            self.regions.append((tag, self.count))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.skipped:
            if tag in self.inner:
                while self.inner.pop() != tag:
                    pass
                return
            if tag == self.skipped:
                self.skipped = ""
                return
            # the end of an element around an unwanted one that has no end tag of its own
            if self.skipped not in IMPLIED or tag not in self.outer or tag in INLINE:
                return
            self.skipped = ""
        if tag in self.outer and tag not in INLINE:
            while self.outer.pop() != tag:
                pass
        if tag == "a":
            self.link = max(0, self.link - 1)
        if tag not in INLINE:
            self.flush()
            self.heading = False
        if tag in REGIONS and any(t == tag for t, _ in self.regions):
            while self.regions.pop()[0] != tag:
                pass

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """``<![`` begins a comment up to the next ``>``, as in browsers, whatever follows it."""
        return self.parse_bogus_comment(i)

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            self.parts.append(data)
            if self.link:
                self.linked += len("".join(data.split()))


def smoothed(ratios: list[float]) -> list[float]:
    """Gaussian smoothing; at the ends the kernel is cut and scaled."""
    out = []
    for i in range(len(ratios)):
        low, high = max(0, i - REACH), min(len(ratios), i + REACH + 1)
        weights = KERNEL[low - i + REACH : high - i + REACH]
        out.append(sum(w * r for w, r in zip(weights, ratios[low:high], strict=True)) / sum(weights))
    return out


def content_lines(lines: list[Line]) -> list[bool]:
    """Whether the smoothed text-to-tag ratio of each line is at least the deviation of all of them."""
    ratios = smoothed([len(x.text) / max(1, x.tags) for x in lines])
    mean = sum(ratios) / len(ratios)
    deviation = math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios))
    return [r >= min(deviation, max(ratios)) for r in ratios]


def parsed(html: str, lenient: bool = False) -> Lines:
    page = Lines(lenient)
    page.feed(html)
    page.close()
    page.flush()
    return page


def main_text(html: str | None) -> str:
    """The main text: blocks in page order, a newline between them. Null, empty or textless: ''."""
    if not html:
        return ""
    page = parsed(html)
    if page.skipped and not any(x.region for x in page.lines):
        # a dropped element was never closed, and took the article with it
        page = parsed(html, lenient=True)
    lines = page.lines
    if not lines:
        return ""
    content = content_lines(lines)
    regions = {x.region for x, c in zip(lines, content, strict=True) if c and x.region}
    if not regions:
        regions = {x.region for x in lines if x.region}
    if regions:
        # rows of links in a stretch of few characters a tag are no text of the article
        return "\n".join(x.text for x, c in zip(lines, content, strict=True) if x.region in regions and (c or not x.links))
    chosen = [i for i, c in enumerate(content) if c]
    first, last = chosen[0], chosen[-1]
    while first and lines[first - 1].heading:
        first -= 1
    return "\n".join(x.text for x in lines[first : last + 1])


def extract(pages: DataFrame) -> DataFrame:
    """Adds text and n_chars to rows of (page_id, url, html); other columns of the input are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                texts = [main_text(x.as_py()) for x in batch.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
