"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams events. Each event that ends a block ends a
*line*, which carries its text, the number of tags met in it, and the nearest
sectioning element around it. The text-to-tag ratios of the lines are smoothed
with a Gaussian kernel, and a threshold at a part of their standard deviation
splits them in two clusters. A region is a section; the sections of one ``article``
(those of an article in it apart) are one region, as are those of a ``main`` that holds
no article. A region is worth the sum of the ratios of its lines in the upper cluster
(whose own ratio is above the threshold, too). Regions worth a part of the best one
or more are the content, and every line of a region belongs to the text, so short
paragraphs between long ones stay.

What pages say about their elements is a weight on the ratios. Elements and roles that
surround an article (menus, forms and so on), and class or id names made of marked
words alone, weigh nothing; a name of which one word is marked weighs an eighth. An
element with such a weight is a region of its own, except that a partly marked name
on a paragraph, heading or item only takes from its vote. Elements without text of
the page (scripts, styles, options and so on) give no lines. End tags that HTML lets
pages leave out are implied, so what follows an unclosed advert isn't lost with it.

A null page has empty text, as has a page without any text.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from stepguard.llm.common import text_slices

# Element names of HTML.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
SKIPPED = set(
    "head title script style noscript template iframe object svg math canvas audio video "
    "button select textarea datalist".split()
)
AROUND = set("nav header footer aside form dialog menu".split())
SECTIONS = set("html body main article section div table td th".split())
#: Elements that a start tag ends where their end tag was left out, and what hides them from it.
CELL_STOPS, ITEM_STOPS = {"table"}, None
IMPLIED = {
    "li": ({"li"}, ITEM_STOPS),
    "dt": ({"dt", "dd"}, ITEM_STOPS),
    "dd": ({"dt", "dd"}, ITEM_STOPS),
    "td": ({"td", "th"}, CELL_STOPS | {"tr"}),
    "th": ({"td", "th"}, CELL_STOPS | {"tr"}),
    "tr": ({"tr"}, CELL_STOPS),
    "tbody": ({"thead", "tbody", "tfoot"}, CELL_STOPS),
    "tfoot": ({"thead", "tbody", "tfoot"}, CELL_STOPS),
    "option": ({"option"}, {"select", "datalist"}),
}
ENDS_P = set(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre section table ul".split()
)
P_STOPS = set("html table td th caption button object template".split())
#: Elements whose end tag ends what is open in them.
HOLDERS = set("ul ol dl tr thead tbody tfoot".split())
BLOCKS = set(
    "address article blockquote body caption center dd details dd div dl dt fieldset figcaption "
    "figure h1 h2 h3 h4 h5 h6 hgroup hr html li main ol p pre section summary table tbody td "
    "tfoot th thead tr ul br".split()
)
ROLES = set("navigation banner contentinfo complementary search form menu menubar dialog".split())
# Words of class and id names that mark what surrounds an article, those
# that mark single paragraphs, headings and items, too, and words that name its kind of box.
PARAGRAPH_WORDS = (
    r"ads?|advert\w*|sponsor\w*|promo\w*|notices?|cookies?|consent|gdpr|comments?|repl(?:y|ies)|share"
    r"|sharing|social|related|recommended|newsletter|subscribe|signup|breadcrumbs?|skip|hidden"
)
WORDS = PARAGRAPH_WORDS + (
    r"|banner|nav\w*|menu\w*|sidebar\w*|aside|footer\w*|masthead|header|popup|modal|overlay"
    r"|commentlist|discussion|disqus|respond|login|search|widget\w*|pagination|pager|toolbar"
)
BOX_WORDS = (
    r"site|page|main|top|bottom|left|right|global|primary|secondary|user|reader|box|block|bar|list|item"
    r"|items|section|area|wrap|wrapper|container|content|inner|outer|thread|form|links?|text|message|id|\d+"
)
MARKED, PARAGRAPH_MARKED, BOX = (
    re.compile(words, re.IGNORECASE) for words in (WORDS, PARAGRAPH_WORDS, BOX_WORDS)
)
PARAGRAPHS = set("p li dt dd h1 h2 h3 h4 h5 h6 span b i em strong a td th tr blockquote pre".split())

SIGMA = 1.0
THRESHOLD = 0.5
#: Least part of the best region's worth.
WORTH = 0.2
PART_MARKED = 0.125


def name_weight(tag: str, value: str) -> float:
    """The weight of a class or id attribute: that of its most marked name."""
    marked = PARAGRAPH_MARKED if tag in PARAGRAPHS else MARKED
    weight = 1.0
    for name in value.split():
        words = [word for word in re.split("[-_]+", name) if word]
        hits = sum(marked.fullmatch(word) is not None for word in words)
        if hits:
            boxes = sum(BOX.fullmatch(word) is not None and marked.fullmatch(word) is None for word in words)
            weight = min(weight, 0.0 if hits + boxes == len(words) else PART_MARKED)
    return weight


class _Lines(HTMLParser):
    """Collects (text, tags, section number, weight) for each line, in page order.

    Without ``weighted`` all weights are one.
    """

    def __init__(self, weighted: bool = True) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, float]] = []
        #: for each section the first one of its region, as far as an article or main joins them
        self.region_of: list[int] = [0]
        #: for each main whether an article is in it
        self.mains: dict[int, bool] = {}
        self._weighted = weighted
        #: name, section and weight outside of it, and whether it has no text
        self._open: list[tuple[str, int, float, bool]] = []
        self._section = 0
        self._weight = 1.0
        self._skipped = 0
        self._text: list[str] = []
        self._tags = 0

    def end_line(self) -> None:
        text = " ".join("".join(self._text).split())
        if text:
            self.lines.append((text, self._tags, self._section, self._weight))
        self._text, self._tags = [], 0

    @staticmethod
    def _weight_of(tag: str, attrs: list[tuple[str, str | None]]) -> float:
        if tag in AROUND:
            return 0.0
        if tag in ("html", "body", "main"):
            return 1.0
        weight = 1.0
        for name, value in attrs:
            if name in ("class", "id") and value:
                weight = min(weight, name_weight(tag, value))
            if name == "role" and value and value.strip().lower() in ROLES:
                return 0.0
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return 0.0
        return weight

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS or tag in SKIPPED or tag in AROUND:
            self.end_line()
        self._tags += 1
        if tag in ENDS_P:
            self._end_implied({"p"}, P_STOPS)
        if tag in IMPLIED:
            self._end_implied(*IMPLIED[tag])
        if tag in VOID:
            return
        weight = self._weight_of(tag, attrs)
        skipped = tag in SKIPPED
        own = weight == 0 or (weight < 1 and tag not in PARAGRAPHS)
        if own or skipped or weight < 1 or tag in SECTIONS:
            self.end_line()
            self._open.append((tag, self._section, self._weight, skipped))
            self._skipped += skipped
            if self._weighted:
                self._weight *= weight
            if tag != "html" and (own or tag in SECTIONS):
                self._start_section(tag, own)
        elif tag in HOLDERS:
            self._open.append((tag, self._section, self._weight, False))
        elif any(tag == name for name, _, _, _ in self._open):
            # the same name again inside such an element, so that its end is told apart
            self._open.append((tag, self._section, self._weight, False))

    def _start_section(self, tag: str, own: bool) -> None:
        section = len(self.region_of)
        alone = own or tag in ("article", "main")
        self.region_of.append(section if alone else self.region_of[self._section])
        if tag == "main":
            self.mains[section] = False
        elif tag == "article" and self.region_of[self._section] in self.mains and not own:
            self.mains[self.region_of[self._section]] = True
        self._section = section

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS or tag in SKIPPED or tag in AROUND:
            self.end_line()
        self._tags += 1
        names = [name for name, _, _, _ in self._open]
        if tag not in names:
            return
        last = len(names) - 1 - names[::-1].index(tag)
        if any(name in ("article", "main") for name in names[last + 1 :]) and tag == "div":
            return  # a stray end tag doesn't close the article around it
        self._close_down_to(last)

    def _close_down_to(self, place: int) -> None:
        self.end_line()
        while len(self._open) > place:
            _, self._section, self._weight, skipped = self._open.pop()
            self._skipped -= skipped

    def _end_implied(self, names: set[str], stops: set[str] | None) -> None:
        """End the innermost of these elements, unless one that hides it is open in it.

        Without stops all hide it but those that an item may leave open.
        """
        for place in range(len(self._open) - 1, -1, -1):
            name = self._open[place][0]
            if name in names:
                self._close_down_to(place)
                return
            if name in stops if stops is not None else name not in ("div", "p", "address"):
                return

    def handle_data(self, data: str) -> None:
        if not self._skipped:
            self._text.append(data)

    def parse_html_declaration(self, i: int) -> int:
        try:
            return super().parse_html_declaration(i)
        except AssertionError:  # an unknown marked section
            return self.parse_bogus_comment(i)

    def close(self) -> None:
        super().close()
        self.end_line()


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing with weights that add up to one at the ends too."""
    radius = int(np.ceil(2 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    total = np.convolve(ratios, kernel)[radius : radius + len(ratios)]
    weight = np.convolve(np.ones(len(ratios)), kernel)[radius : radius + len(ratios)]
    return total / weight


def page_text(
    html: str, sigma: float = SIGMA, threshold: float = THRESHOLD, worth: float = WORTH, weighted: bool = True
) -> tuple[str, int, int]:
    """The main text, and how many of the page's lines it holds.

    Without ``weighted`` the ratios alone decide, whatever elements and classes are called.
    """
    parser = _Lines(weighted)
    parser.feed(html)
    parser.close()
    lines = parser.lines
    if not lines:
        return "", 0, 0
    ratios = np.array([weight * len(text) / max(1, tags) for text, tags, _, weight in lines], dtype=float)
    smooth = smoothed(ratios, sigma)
    cut = threshold * smooth.std()
    # smoothing lifts a menu beside a long paragraph, too; its own ratio stays low
    content = (smooth >= cut) & (ratios >= cut) & (ratios > 0)
    region = []
    for _, _, section, _ in lines:
        joined = parser.region_of[section]
        # a main that has articles joins nothing, as body doesn't
        region.append(section if joined == 0 or parser.mains.get(joined, False) else joined)
    value = np.bincount(region, np.where(content, ratios, 0.0))
    chosen = (value > 0) & (value >= worth * value.max())
    kept = [text for (text, _, _, _), r in zip(lines, region, strict=True) if chosen[r]]
    return " ".join(kept), len(kept), len(lines)


def main_text(html: Column, sigma: float = SIGMA, threshold: float = THRESHOLD) -> Column:
    """A struct of ``text``, ``kept_lines`` and ``lines`` for each page."""

    @F.pandas_udf("text string, kept_lines int, lines int")
    def extract(pages: pd.Series) -> pd.DataFrame:
        found = [
            page_text(page, sigma, threshold) for _, part in text_slices(pages) for page in part
        ]
        texts, kept, lines = zip(*found, strict=True) if found else ((), (), ())
        return pd.DataFrame(
            {"text": pd.Series(texts, dtype=object), "kept_lines": kept, "lines": lines}
        )

    return extract(html)
