"""Main text of web pages by text-to-tag ratio.

A page is read as events of the standard library's parser.  Every block-level
boundary ends a line; a line has its text, how many tags it holds, how much of
its text is links, and the containers around it.  The ratio of text outside
links to tags, smoothed with a Gaussian along the lines of a section, is split
by a threshold into two clusters, content and the rest.  The content lines
select the regions: the smallest section that holds them all, without those
smaller ones in it that hold no content line and stand before the first or after
the last one.  An article or main element is selected as a whole.  Every line of a
selected region is main text, short ones too.  Lines inside menus, headers, footers,
sidebars and forms, by element or role, weigh nothing and are never content.

Names decide nothing by themselves: a container whose class or id calls it an advert,
a notice, comments and the like makes its text weigh less, and is left out where the
clusters then find no content in it.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.llm._shared import let_go

# Element names of the HTML standard.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img picture source".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template noscript head iframe object svg math canvas select option textarea button".split())
BOILER = frozenset("nav footer aside form dialog menu".split())
# Elements that a head may hold; any other ends it.
HEAD = frozenset("base basefont bgsound link meta title noscript noframes script style template head html".split())
# Elements that divide a page into sections.
SECTIONS = frozenset("html body div section article main header hgroup address center details table nav footer aside form dialog menu".split())
# Words by which pages name what is not their article, and words that
# stand beside them in such names; a name of which any other word is part says nothing.
NAMES = frozenset("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside cookie cookies consent notice alert popup modal overlay newsletter subscribe signup login search share sharing social related recommended comment comments discussion disqus replies responses widget toolbar pagination pager copyright disclaimer".split())
BESIDE = frozenset("the site page main top bottom left right inner outer box bar block area list item items wrapper container section content link links form panel primary secondary global web user reader post article".split())
# Elements that hold a block of text of their own: their names are anchors.
ANCHORED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dt dd figure figcaption caption td th tr".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
# Elements that close an open element of the same kind, or a paragraph.
SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LISTS, BLOCKS = ("ul", "ol", "dl", "table", "menu"), ("div", "article", "section", "main", "body", "td", "li")
# Elements that hold one whole text: what the clusters select of it selects all of it.
# A header in one of these is that of the text, not of the page; their own names say nothing.
TEXTS = ("article", "main")
SIGMA, ALIKE = 2.0, 0.7
#: What text in a container with a name of ``NAMES`` weighs.
NAMED = 0.05
_WORD = re.compile(r"[a-z0-9]+")


class Lines(HTMLParser):
    """Collects the lines of a page from parser events.

    Each event takes constant time, apart from elements that it closes: where
    elements of a name stand open is kept by name.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.tags: list[int] = []
        self.linked: list[int] = []
        self.inside: list[int] = []  # the innermost container of each line
        self.dropped: list[bool] = []
        # Of each container; the first is the page.  ``whole`` is the outermost text that it is in, or 0,
        # and ``named`` the outermost container with a name of NAMES.
        self.parents, self.is_section, self.whole, self.named = [-1], [True], [0], [0]
        self.open: list[tuple[str, int, bool, bool]] = []  # name, container, silent, boiler
        self.places: dict[str, list[int]] = defaultdict(list)  # of open elements, by name
        self.parts: list[str] = []
        self.count = self.links = self.muted = 0

    def _state(self) -> tuple[int, bool, bool]:
        return self.open[-1][1:] if self.open else (0, False, False)

    def _end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            container, _, boiler = self._state()
            self.texts.append(text)
            self.tags.append(self.count)
            self.linked.append(self.links)
            self.inside.append(container)
            self.dropped.append(boiler)
        self.parts, self.count, self.links = [], 0, 0

    def _last(self, names: tuple[str, ...]) -> int:
        """The place of the last open element of these names, or -1."""
        return max(self.places[name][-1] if self.places[name] else -1 for name in names)

    def _close(self, at: int) -> None:
        if any(name not in INLINE for name, *_ in self.open[at:]):
            self._end_line()
        for name, *_ in self.open[at:]:
            self.places[name].pop()
            self.muted -= name in SILENT and name != "head"
        del self.open[at:]

    def _close_last(self, names: tuple[str, ...], stop: tuple[str, ...]) -> None:
        at = self._last(names)
        if at > self._last(stop):
            self._close(at)

    def handle_starttag(self, tag, attrs):
        if tag not in HEAD and self.places["head"] and not self.muted:
            # An end tag </head> may be left out; inside a silent element tags are no sign of it.
            self._close(self.places["head"][-1])
        if tag not in INLINE:
            self._end_line()
            if tag in SELF_CLOSING:
                self._close_last(SELF_CLOSING[tag], LISTS)
            else:
                # A block ends an open paragraph, and inline elements left open in it.
                self._close_last(("p",), BLOCKS)
        self.count += 1
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        container, silent, boiler = self._state()
        plain = tag not in TEXTS and tag not in ("body", "html")
        if tag not in INLINE and tag != "p":
            named = plain and tag not in ANCHORED and self._named(attrs)
            self.parents.append(container)
            self.is_section.append(named or tag in SECTIONS)
            self.whole.append(self.whole[container] or len(self.whole) * (tag in TEXTS))
            self.named.append(self.named[container] or len(self.named) * named)
            container = len(self.parents) - 1
        if not boiler and plain:
            boiler = tag in BOILER or tag == "header" and self._last(TEXTS) < 0 or self._hidden(attrs)
        self.places[tag].append(len(self.open))
        self.open.append((tag, container, silent or tag in SILENT, boiler))
        self.muted += tag in SILENT and tag != "head"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    @staticmethod
    def _named(attrs) -> bool:
        for key, value in attrs:
            if key in ("class", "id") and value:
                for name in value.lower().split():
                    words = _WORD.findall(name)
                    if not NAMES.isdisjoint(words) and all(w in NAMES or w in BESIDE or w.isdigit() for w in words):
                        return True
        return False

    @staticmethod
    def _hidden(attrs) -> bool:
        return any(key == "hidden" or key == "role" and value and value.lower() in ROLES for key, value in attrs)

    def handle_endtag(self, tag):
        self.count += 1
        if self.places[tag]:
            self._close(self.places[tag][-1])

    def handle_data(self, data):
        if not (self.open and self.open[-1][2]):
            self.parts.append(data)
            if self.places["a"]:
                self.links += len(data)

    def finish(self) -> None:
        self.close()
        self._end_line()


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """A Gaussian-weighted mean along the lines, normalised at both ends."""
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    middle = slice(reach, reach + len(values))
    return np.convolve(values, kernel)[middle] / np.convolve(np.ones(len(values)), kernel)[middle]


def smooth_by_section(values: np.ndarray, sections: np.ndarray) -> np.ndarray:
    """``smooth`` over the lines of each section by themselves."""
    out, order = np.empty(len(values)), np.argsort(sections, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(sections[order])) + 1):
        out[part] = smooth(values[part])
    return out


def threshold(values: np.ndarray) -> float:
    """The cut between two clusters: the mean of their means, iterated to rest; but
    at most ``ALIKE`` of the upper mean, so that values that are much alike stay one."""
    cut = float(values.mean())
    for _ in range(50):
        high, low = values[values > cut], values[values <= cut]
        new = (float(high.mean()) + float(low.mean())) / 2 if len(high) and len(low) else cut
        if abs(new - cut) < 1e-9:
            break
        cut = new
    return min(cut, ALIKE * float(values[values >= cut].mean()))


def content_lines(page: Lines) -> np.ndarray:
    """Which lines are in the cluster of content."""
    dropped = np.array(page.dropped)
    plain = np.maximum(np.array([len(t) for t in page.texts], float) - np.array(page.linked), 0)
    section = list(range(len(page.parents)))
    for c in range(1, len(section)):
        section[c] = c if page.is_section[c] else section[page.parents[c]]
    named = np.array([page.named[c] > 0 for c in page.inside])
    ratio = np.where(dropped, 0.0, plain / np.maximum(page.tags, 1)) * np.where(named, NAMED, 1.0)
    level = smooth_by_section(ratio, np.array([section[c] for c in page.inside]))
    candidates = ~dropped & (ratio > 0)
    if not candidates.any():
        return candidates
    cut = threshold(level[~dropped])
    return ~dropped & (level >= min(cut, level[candidates].max()))


def regions(page: Lines, content: np.ndarray) -> list[bool]:
    """For each container whether its lines are in a selected region."""
    n, first, last = len(page.parents), {}, {}
    held = np.zeros(n, np.int64)
    for i, c in enumerate(page.inside):
        first.setdefault(c, i)
        last[c] = i
        held[c] += content[i]
    # Content lines and the span of lines of each container, from the leaves up.
    for c in range(n - 1, 0, -1):
        p = page.parents[c]
        held[p] += held[c]
        if c in first:
            first[p], last[p] = min(first[c], first.get(p, first[c])), max(last[c], last.get(p, last[c]))
    lines = np.flatnonzero(content)
    chosen = max(c for c in range(n) if held[c] == len(lines) and page.is_section[c])
    chosen = page.whole[chosen] or chosen
    out = [False] * n
    out[chosen] = True
    for c in range(chosen + 1, n):
        if out[page.parents[c]]:
            part_of = page.whole[c] and (page.whole[c] <= chosen or held[page.whole[c]])
            apart = not part_of and page.is_section[c] and not held[c] and c in first and (last[c] < lines[0] or first[c] > lines[-1])
            out[c] = not apart
    return out


def extract(html: str | None) -> str:
    """The main text of a page; an empty text if it has none.

    Blocks stand in page order, joined by one space; white space inside a block
    is one space; character references are decoded.  Null and empty pages have
    an empty text.
    """
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.finish()
    content = content_lines(page) if page.texts else np.zeros(0, bool)
    if not content.any():
        return ""
    ok = regions(page, content)
    # Named containers stay where the clusters have found content in them.
    stays = {0, *(page.named[c] for c, is_content in zip(page.inside, content, strict=True) if is_content)}
    return " ".join(t for t, c, gone in zip(page.texts, page.inside, page.dropped, strict=True) if ok[c] and not gone and page.named[c] in stays)


def main_text(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The main text of every page.

    Returns ``keep`` (all columns of ``pages`` if None) and text, n_chars (long,
    its code points).  Repeated rows are each read; an empty table gives an
    empty result; columns named like the new ones are replaced.  No shuffle; a
    task holds one batch of pages and the lines of one page.
    """
    held = [c for c in (pages.columns if keep is None else keep) if c not in ("text", "n_chars")]
    frame = pages.select(*[F.col(f"`{c}`") for c in held], F.col(html).alias("__residua_html"))
    schema = frame.drop("__residua_html").withColumns({"text": F.lit(""), "n_chars": F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            texts = [extract(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*batch.schema.names[:-1], "text", "n_chars"])

    return frame.mapInArrow(run, schema)
