"""Main text of web pages by line-block distribution.

Markup is stripped to lines: one for every block-level element with text, and
elements that never hold an article (scripts, navigation, forms, asides,
containers that are named as adverts, notices, comments and the like) leave only
empty lines behind. The text lengths of the lines are summed over a sliding
window. The curve dives to nothing where a whole window is empty; a stretch
between two dives is kept whole, short paragraphs included, if the curve surges
past the threshold in it. A mark of the page's own (article, main) weighs in: a
marked line counts as long enough to surge by itself, and lines outside count
nothing, provided that the marked lines have most of the page's text. Where they
don't (teaser cards), the marks count nothing and the curve alone decides.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that begin and end a line.
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript ol option p pre section select summary table tbody td template tfoot th thead title tr ul".split())
#: Elements whose content is never article text.
SKIPPED = frozenset("aside button dialog footer form head header iframe menu nav noscript object script select style svg template textarea title canvas audio video".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Names (a whole class, id or role) of containers of boilerplate, alone or with such an ending.
NAMED = re.compile(r"(?:ads?|adverts?|advertisements?|adsense|banner|breadcrumbs?|comments?|commentlist|complementary|contentinfo|cookies?|consent|disqus|footer|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|overlay|pagination|pager|popup|promo|promoted|related|replies|reply|search|share|sharing|sidebar|signup|social|sponsor|sponsored|subscribe|toolbar|widgets?)(?:[-_]+(?:area|articles|banner|bar|block|box|buttons?|consent|container|content|form|inner|left|links?|list|main|menu|notice|popup|posts|right|section|slot|stories|top|bottom|unit|widget|wrap|wrapper|[0-9]+))*", re.I)
#: Elements that hold a piece of text each: a name doesn't make boilerplate of them.
TEXTUAL = frozenset("b blockquote caption cite code dd dt em figcaption h1 h2 h3 h4 h5 h6 i li p pre q strong td th".split())
#: Elements that a closing parent or a sibling ends implicitly.
CLOSED_BY = {"p": BLOCKS - {"br", "html", "body"}, "li": {"li"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
#: An end tag of another element, but for the closing ones, doesn't reach beyond these.
BARRIERS = frozenset("article main body table nav footer aside".split())
CLOSING = frozenset("article main body html section div".split())
_SPACE = re.compile(r"[\s ]+")


class _Lines(HTMLParser):
    """Lines of a page: (text, inside an element that marks the article)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str | None, bool]] = []
        self.parts: list[str] = []
        self.stack: list[str] = []
        self.open: dict[str, list[int]] = {}  # depths of the open elements of each name
        self.barriers: list[int] = []
        self.skip: list[int] = []  # depths of open elements that hold no article text
        self.marks: list[int] = []  # depths of open article and main elements

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.lines.append((text, bool(self.marks)))
        self.parts.clear()

    def leave(self, depth: int) -> None:
        """Close every element from ``depth`` up."""
        while len(self.stack) > depth:
            self.open[self.stack.pop()].pop()
        for held in (self.skip, self.marks, self.barriers):
            while held and held[-1] >= depth:
                held.pop()

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
        while self.stack and tag in CLOSED_BY.get(self.stack[-1], ()):
            self.leave(len(self.stack) - 1)
        if tag in VOID:
            return
        depth = len(self.stack)
        self.stack.append(tag)
        self.open.setdefault(tag, []).append(depth)
        if tag in BARRIERS:
            self.barriers.append(depth)
        if self.skip:
            return
        inside = bool(self.marks)
        named = any(NAMED.fullmatch(name) for k, v in attrs if v and k in ("class", "id", "role") for name in v.split())
        hidden = any(k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and v and re.search(r"display\s*:\s*none", v)) for k, v in attrs)
        if (tag in SKIPPED and not (inside and tag == "header")) or hidden or (named and tag not in TEXTUAL and tag not in ("html", "body", "article", "main")):
            self.lines.append((None, inside))  # a gap, in which the curve dives to nothing
            self.skip.append(depth)
        elif tag in ("article", "main"):
            self.marks.append(depth)

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        depth = (self.open.get(tag) or [-1])[-1]
        if depth >= 0 and (tag in CLOSING or not self.barriers or self.barriers[-1] <= depth):
            self.leave(depth)

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


def lines_of(page: str) -> list[tuple[str | None, bool]]:
    parser = _Lines()
    parser.feed(page)
    parser.close()
    parser.flush()
    return parser.lines


def main_text(page: str | None, window: int = 3, surge: int = 80) -> str:
    """Blocks of the article in page order, joined by line feeds."""
    if not page:
        return ""
    # Boilerplate leaves as many empty lines as a window has.
    lines = [x for text, inside in lines_of(page) for x in ([(text, inside)] if text else [("", inside)] * window)]
    texts = [text for text, _ in lines]
    sizes = np.array([len(x) for x in texts], dtype=np.int64)
    inside = np.array([x for _, x in lines], dtype=bool)
    if not sizes.sum():
        return ""
    if 2 * sizes[inside].sum() > sizes.sum():
        sizes = np.where(inside & (sizes > 0), np.maximum(sizes, surge), 0)
    # curve[i]: text in the lines i .. i + window - 1
    total = np.concatenate(([0], np.cumsum(sizes)))
    ends = np.minimum(np.arange(len(sizes)) + window, len(sizes))
    curve = total[ends] - total[:-1]
    # Stretches between two dives, and those of them that surge. The threshold is never above the page's top.
    stretch = np.cumsum(curve == 0)
    high = np.unique(stretch[(curve >= min(surge, int(curve.max()))) & (curve > 0)])
    keep = np.isin(stretch, high) & (sizes > 0)
    return "\n".join(texts[i] for i in np.flatnonzero(keep).tolist())


def _extract(window: int, surge: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = [main_text(x, window, surge) for x in batch.column("_html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["_a", "_b", "text", "n_chars"])

    return run


def extract_main_text(pages: DataFrame, window: int = 3, surge: int = 80, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The article of every page: ``id_col``, ``url_col``, ``text`` and ``n_chars`` (code points).

    Null, empty and text-free pages give empty text, an empty table an empty
    table. Pages of any length are read whole, in time in proportion to their
    length. Rows are handled one by one, so repeated rows give equal results; a
    null id or url stays null; other columns are ignored, so none can clash.
    """
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    rows = pages.select(F.col(id_col).alias("_a"), F.col(url_col).alias("_b"), F.col(html_col).alias("_html"))
    out = rows.mapInArrow(_extract(window, surge), f"_a {kinds[0]}, _b {kinds[1]}, text string, n_chars long")
    return out.select(F.col("_a").alias(id_col), F.col("_b").alias(url_col), "text", "n_chars")
