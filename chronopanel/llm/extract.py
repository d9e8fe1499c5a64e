"""Main text of web pages: text-to-tag ratio per line, smoothed and clustered.

A streaming parser turns a page into lines, one for each block of text, with the number of
tags met since the line before and the elements that hold it. Parts that are never content
by their element, role or name are marked; a name with other words in it counts only where
the text is thin, and none counts on what holds an article. The ratio of text to tags per line is smoothed
by a Gaussian; a two-means threshold splits the lines into two clusters. The content region
is the smallest container that holds all unmarked lines of the upper cluster, articles first;
all its lines count, short ones too, except marked ones. Of several articles those count whose
text is not far shorter than the longest one's, as teasers are articles as well. An article inside another one is a comment on it, and an article inside
comments is one of them, unless the page would be left with nothing.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from chronopanel.llm.common import columns

#: Elements that begin and end a block, have no end tag, never hold content,
#: hold what is not text, and end an open paragraph's like.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul head title".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE = frozenset("nav header footer aside form head title menu dialog button select option textarea fieldset label".split())
NO_TEXT = frozenset("script style noscript template iframe object svg canvas audio video head title select textarea button".split())
SELF_ENDING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
#: Elements that can be the content region, and those whose text beside one belongs to it.
CONTAINERS = frozenset("html body main article section div center td".split())
BESIDE_TEXT = frozenset("p blockquote pre h1".split())
#: Words in a class, id or role that name a part beside the article.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox banner billboard sponsor sponsored sponsors promo promotion promoted "
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar sidebars aside widget widgets header masthead topbar footer foot bottombar "
    "cookie cookies consent gdpr notice notices alert notification popup modal overlay comment comments commentlist comentarios respond disqus reply replies discussion "
    "share sharing social related recommended recommendations feedback newsletter subscribe subscription signup login search pagination pager toolbar tags copyright legal disclaimer "
    "complementary contentinfo hidden".split()
)
TITLES = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Names of what readers write, which an article in it does not lift; names that
#: paragraphs of an article can have for what they say.
READERS = frozenset("comment commentlist comentario respond disqus reply replie discussion feedback".split())
SAID = frozenset("legal notice alert notification related discussion disclaimer".split())
#: The share of the longest article's text that another one needs.
RICH = 0.1
#: What a head holds; anything else ends one that is left open.
HEAD = frozenset("base basefont bgsound link meta title style script noscript template head".split())
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Fixed value: white space of HTML, a no-break space included.
WHITE = re.compile(r"[\s\xa0]+")


def beside(tag: str, attrs) -> int:
    """How surely an element holds a part beside the article by what it is: 3 the head,
    2 lost only to a main, 1 lost to an article too, 0 no sign."""
    if tag == "head":
        return 3
    return 0 if tag not in OUTSIDE or tag == "form" else 2 if tag in ("nav", "aside", "footer") else 1


def named(tag: str, attrs) -> tuple[int, set[str]]:
    """2 if a class, id or role says only that an element is beside the article (so does a form), 1 if
    it says more, 0 if it doesn't say so; and the words that do."""
    sure, said = 2 * (tag == "form"), set()
    for key, value in attrs:
        # titles and paragraphs have ids as targets of links
        if value and (key in ("class", "role") and tag not in TITLES or key == "id" and tag not in TITLES and tag != "p"):
            for token in value.split():
                words = [w.lower() for w in WORD.findall(token)]
                found = [w for w in words if w in NAMES]
                if found:
                    said.update(w.removesuffix("s") for w in found)
                    only = len(found) == len(words) and not (tag == "p" and said <= SAID)
                    sure = max(sure, 2 if only else 1)
    return sure, said


class Lines(HTMLParser):
    """The blocks of text of a page in order, as (text, tags, holders, marked by an element)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, tuple[int, ...], bool]] = []
        self.open: list[tuple[str, int, int, bool]] = []  # tag, number, how surely marked, without text
        self.text: list[str] = []
        self.tags = self.number = 0
        self.kinds: dict[int, str] = {}
        self.names: dict[int, tuple[int, set[str]]] = {}  # of the elements with a name of a part beside

    def end_line(self):
        if self.text:
            text = WHITE.sub(" ", "".join(self.text)).strip()
            self.text.clear()
            if text:
                marked = bool(self.open and self.open[-1][2])
                self.lines.append((text, self.tags, tuple(n for _, n, _, _ in self.open), marked))
                self.tags = 0

    def pop_to(self, at: int):
        self.end_line()
        del self.open[at:]

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag not in HEAD:
            self.end_head(tag == "body")
        if tag in BLOCKS:
            self.end_line()
            for k in range(len(self.open) - 1, -1, -1):
                name = self.open[k][0]
                if name == "p" or name in SELF_ENDING.get(tag, ()):
                    self.pop_to(k)
                    break
                if name in BLOCKS:
                    break
        if tag == "br":
            self.text.append(" ")
        if tag not in VOID:
            above = self.open[-1] if self.open else ("", 0, 0, False)
            self.number += 1
            self.kinds[self.number] = tag
            marked, (sure, said) = above[2], named(tag, attrs)
            if tag in ("article", "main"):
                # an article is no part of what is beside it, unless it has the same name or lies in what readers wrote
                of = [self.names[n] for _, n, _, _ in self.open if n in self.names]
                if not any(said & words or how == 2 and words & READERS for how, words in of):
                    marked = 0 if marked <= 1 + (tag == "main") else marked
                    for _, n, _, _ in self.open:
                        self.names.pop(n, None)
            elif sure and tag not in ("html", "body"):
                self.names[self.number] = (sure, said)
            if tag in TITLES:
                marked = self.above_header(marked)
            self.open.append((tag, self.number, max(marked, beside(tag, attrs)) if tag not in ("html", "body", "article", "main") else marked, above[3] or tag in NO_TEXT))

    def above_header(self, marked: int) -> int:
        """The mark of a title: an article's own header does not take its title away."""
        at = max((k for k, x in enumerate(self.open) if x[0] in ("article", "main")), default=None)
        if at is None or any(beside(x[0], ()) and x[0] != "header" for x in self.open[at + 1 :]):
            return marked
        return self.open[at][2]

    def end_head(self, all_of_it: bool):
        """Ends a head that was left open; with what is open in it, or if nothing is."""
        at = next((k for k, x in enumerate(self.open) if x[0] == "head"), None)
        if at is not None and (all_of_it or at == len(self.open) - 1):
            self.pop_to(at)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                if tag in BLOCKS:
                    self.pop_to(k)
                else:
                    del self.open[k:]
                return
            if tag not in BLOCKS and self.open[k][0] in BLOCKS:
                return

    def handle_data(self, data):
        if self.open and self.open[-1][0] == "head" and WHITE.sub("", data):
            self.end_head(False)
        if not (self.open and self.open[-1][3]):
            self.text.append(data)


def smoothed(values: list[float], radius: int = 2, sigma: float = 1.0) -> list[float]:
    """Gaussian smoothing; weights outside the page are left out."""
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - radius), min(len(values), i + radius + 1)
        w = kernel[lo - i + radius : hi - i + radius]
        out.append(sum(a * b for a, b in zip(w, values[lo:hi])) / sum(w))
    return out


def threshold(values: list[float]) -> float:
    """The middle between the means of two clusters."""
    low, high = min(values), max(values)
    for _ in range(50):
        cut = (low + high) / 2
        upper, lower = [v for v in values if v >= cut], [v for v in values if v < cut]
        a, b = (sum(lower) / len(lower) if lower else low), (sum(upper) / len(upper) if upper else high)
        if (a, b) == (low, high):
            break
        low, high = a, b
    return (low + high) / 2


def region_of(upper: list[tuple[int, ...]], own: list[tuple[int, ...]], kinds: dict[int, str]) -> set[int]:
    """The elements whose unmarked lines are the main text, from the holders of the unmarked lines
    of the upper cluster and of all unmarked lines; empty for the whole page.

    The outermost articles if they hold all of the upper cluster, else the outermost mains, else
    the smallest container that holds all of it and is no block of its own, grown to its parent
    while paragraphs or titles stand beside it. Articles count in any case.
    """
    first = lambda held, kind: next((n for n in held if kinds[n] == kind), 0)
    articles = {first(h, "article") for h in own} - {0}
    for kind in ("article", "main"):
        if all(first(h, kind) for h in upper):
            return articles | {first(h, kind) for h in own} - {0}
    # holders are a path from the outermost element, so what all hold is the common beginning
    low, high = min(upper), max(upper)
    depth = next((k for k, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
    for k in range(depth - 1, -1, -1):
        n = low[k]
        if kinds[n] not in CONTAINERS or sum(len(h) > k and h[k] == n for h in own) < 2:
            continue
        above = next((j for j in range(k - 1, -1, -1) if kinds[low[j]] in BLOCKS), None)
        grows = kinds[n] not in ("article", "main", "body") and above is not None
        if grows and any(len(h) > above + 1 and h[above] == low[above] and h[above + 1] != low[above + 1] and kinds[h[above + 1]] in BESIDE_TEXT for h in own):
            continue
        return articles | {n}
    return set()


def parts_beside(p: Lines, dense: list[bool]) -> set[int]:
    """The elements that are beside the article by their name.

    A name that says nothing else marks its element. One with other words does so unless half
    of the element's characters, or half of all the page's that are dense, are dense in it.
    """
    out = {n for n, (sure, _) in p.names.items() if sure == 2}
    weak = {n: [0, 0] for n, (sure, _) in p.names.items() if sure == 1}
    total = 0
    if weak:
        for (text, _, holders, marked), thick in zip(p.lines, dense):
            if not marked and out.isdisjoint(holders):
                total += thick * len(text)
                for n in holders:
                    if n in weak:
                        weak[n][0] += len(text)
                        weak[n][1] += thick * len(text)
    return out | {n for n, (size, thick) in weak.items() if not thick or 2 * thick < size and 2 * thick < total}


def poor_articles(lines: list[tuple[str, tuple[int, ...], float]], kinds: dict[int, str]) -> set[int]:
    """The articles that are not the page's: inside another one that has text of its own, or far
    shorter than the longest. `lines` are the unmarked ones."""
    rich: dict[int, int] = {}
    own: dict[int, int] = {}
    inner: dict[int, int] = {}
    for text, holders, _ in lines:
        held = [n for n in holders if kinds[n] == "article"]
        if held:
            size = len(text)
            rich[held[0]] = rich.get(held[0], 0) + size
            own[held[0]] = own.get(held[0], 0) + size * (len(held) == 1)
            inner.update((n, held[0]) for n in held[1:])
    least = RICH * max(rich.values(), default=0)
    poor = {n for n, size in rich.items() if size < least}
    return poor | {n for n, outer in inner.items() if own[outer] and own[outer] >= RICH * rich[outer]}


def main_text(html: str | None) -> str:
    """The main text of a page: blocks joined by an empty line, "" if there is none."""
    p = Lines()
    p.feed(html or "")
    p.close()
    p.end_line()
    if all(line[3] for line in p.lines):
        return ""
    # the ratio is taken over all lines of the page, marked parts included
    raw = [len(text) / max(1, tags) for text, tags, _, _ in p.lines]
    ratio = smoothed(raw)
    cut = threshold(ratio)
    out = parts_beside(p, [r >= cut * (1 - 1e-9) for r in raw])
    lines = [(text, holders, r) for (text, _, holders, marked), r in zip(p.lines, ratio) if not marked and out.isdisjoint(holders)]
    if not lines:
        return ""
    poor = poor_articles(lines, p.kinds)
    lines = [line for line in lines if poor.isdisjoint(line[1])]
    # if only marked parts reach the upper cluster, all unmarked lines count
    own = [holders for _, holders, _ in lines]
    upper = [holders for _, holders, r in lines if r >= cut]
    region = region_of(upper or own, own, p.kinds)
    return "\n\n".join(text for text, holders, _ in lines if not region or not region.isdisjoint(holders))


def extract(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    Null and empty pages, and pages without text outside menus and the like, give an empty
    text. Pages are read whole, broken markup included; repeated rows give a row each, an
    empty table an empty one; other columns play no part.
    """
    rows = columns(pages, page_id=id, url=url, html=html)
    kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column(2)]
            made = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
